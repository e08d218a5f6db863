import os

for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # many small products: threads only get in each other's way
    os.environ.setdefault(name, "1")

import pandas as pd  # noqa: E402
import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(60_000))
    plain = "some words of a plain document that says nothing much but goes on for a while, about rivers and hills"
    rows = [
        (1, plain, "en", "a", 5),
        (1, plain, "en", "a", 5),
        (1, plain, "en", "a", 5),
        (2, plain, "en", "b", 5),
        (3, None, None, None, None),
        (None, None, None, None, None),
        (None, plain + " indeed", "en", None, 1),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", "b", 0),
        (6, long, "en", "a", len(long)),
        (7, "ein zwei drei", "de", "", 3),
        (8, "é" * 50_000, "fr", "c", 1),
    ]
    extra = "size long, shard int, slot int, host string, kept boolean, score double, _t string, _id long, _doc string, fp long, taken long, source_size int, epoch int, root long"
    full = [(*r, 1, 2, 3, "h", None, 0.5, "t", 9, "d", 4, 5, 6, 7, 8) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small():
    return pd.read_parquet(f"{SF}/documents.parquet")
