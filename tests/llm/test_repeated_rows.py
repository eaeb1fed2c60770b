from collections import Counter

from locusmill.llm import mixing, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_emits_repeated_rows_by_their_own_copies(spark):
    rows = [(7, " ".join(f"a{i}" for i in range(10)), "en", "src0", 1)] * 6 + [(None, "b c d e", "en", "src0", 1)] * 4 + [(i, f"x{i} y z", "en", "src0", 1) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for share in (30, 50, 130):
        p = mixing.MixParams(share=share, max_epochs=2)
        want = Counter()
        for r in mixing.choose(docs, mixing.document_levels(), p).collect():
            want[r["doc_id"]] += r["copies"]
        mixed = mixing.mix_documents(docs, p).collect()
        assert Counter(r["doc_id"] for r in mixed) == want
        assert sum(len(r["text"].split()) for r in mixed) <= share * sum(len(r[1].split()) for r in rows) // 100
        own = Counter(r[0] for r in rows)
        assert all(n <= 2 * own[i] for i, n in want.items())


def test_near_dedup_keeps_one_row_for_repeated_and_null_ids(spark):
    def t(seed):
        return " ".join(f"w{seed}_{i}" for i in range(60))

    rows = [(4, t(1)), (4, t(1)), (None, t(1)), (None, t(2)), (None, t(2)), (5, t(3)), (5, t(4)), (3, t(4)), (None, t(5)), (9, t(5)), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(4, t(1)), (None, t(2)), (5, t(3)), (3, t(4)), (9, t(5)), (8, ""), (8, "")]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c", "en", "src0", 1, i, "x", "y") for i in range(30)], SCHEMA + ", _copies long, copies string, row string")
    mixed = mixing.mix_documents(docs, mixing.MixParams(share=150, max_epochs=2))
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert len(rows) == 45 and all(r["_copies"] == r["doc_id"] and r["row"] == "y" for r in rows)


def test_op10_sql_on_edge_rows(spark, tmp_path):
    import duckdb

    rows = [(1, "a b c", None, "src1", 1)] * 3 + [(None, "d e", "en", None, 1)] * 2 + [(2, None, "en", "src0", 1), (3, "", "fr", "x", 1)] + [(i, f"w{i} x y", ("en", "fr")[i % 2], f"src{i % 3}", 1) for i in range(10, 60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in mixing.op10_hierarchical_budgets(spark, str(tmp_path)).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(con.execute(f"select doc_id, domain, lang, source, n_tokens, copies from ({mixing.OP10_SQL})").fetchall())


def test_a_repeated_doc_id_joins_the_components_of_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (7, "own words"), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False), (7, 7, True)]


def test_near_dedup_keeps_columns_of_any_name(spark):
    from locusmill.llm.neardup import drop_near_duplicates

    text = " ".join(f"word{i}" for i in range(80))
    names = "doc_id long, text string, _row string, own string, _id string, c string, `first` string"
    docs = spark.createDataFrame([(2, text, "a", "b", "c", "d", "e"), (1, text, "f", "g", "h", "i", "j"), (None, None, "k", None, "l", "m", "n")], names)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text, "f", "g", "h", "i", "j"), (None, None, "k", None, "l", "m", "n")], key=str)
