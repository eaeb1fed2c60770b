import numpy as np
import pytest

from locusmill.llm import weaklabels


def prose(rng, n=120):
    stock = "the a of and to in is was for on that with as by at from it an be this which or are not have had his her they we you were been their".split() + [f"word{i}" for i in range(300)]
    lines = [" ".join(stock[int(x)] for x in rng.zipf(1.4, 12) % len(stock)).capitalize() + "." for _ in range(n // 12)]
    return "\n".join(lines)


def junk(rng):
    return " ".join("".join(rng.choice(list("#$%&|<>0123456789@^~"), 9)) for _ in range(60))


@pytest.mark.parametrize("extra", ["none", "junk without ids", "prose without ids", "junk under one id", "copies without ids"])
def test_rows_without_ids_do_not_take_the_training_sample(spark, extra):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng)) for i in range(400)] + [(400 + i, junk(rng)) for i in range(100)]
    one = junk(rng)
    more = {"junk without ids": lambda: (None, junk(rng)), "prose without ids": lambda: (None, prose(rng)), "junk under one id": lambda: (7777, junk(rng)), "copies without ids": lambda: (None, one)}
    rows += [more[extra]() for _ in range(400)] if extra != "none" else []
    p = weaklabels.WeakParams(train_rows=200)
    out = weaklabels.classify(spark.createDataFrame(rows, "doc_id long, text string"), p).filter("doc_id < 500")
    good, bad = out.filter("doc_id < 400 and kept").count(), out.filter("doc_id >= 400 and kept").count()
    assert good >= 390 and bad <= 2
