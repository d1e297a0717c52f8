import pytest

from staylight.llm.queries import _find_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def _package(spark):
    _find_package(spark)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, (id, text) pairs or nothing at all."""

    def build(rows, partitions=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest test tables, as lists."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    return folder, [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts at the edges: missing, empty, blank, one word, very long, other scripts."""
    return [
        None, "", " ", "\n\n", "word", "a b c d e f g h i j k l", "x " * 30_000, "é ü \x1c\x85 中文字 🙂🙂 ½²",
        "a b c d e f g h i j k l", "Kelvin İstanbul ſecret", "'", "don't  stop\t\tnow \r\n ok'll", "a" * 5000,
    ]
