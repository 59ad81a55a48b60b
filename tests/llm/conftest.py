import pytest

ROOT = "/root/testdata"
SMALL = f"{ROOT}/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows, columns with names of results."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        (1, "the cat sat on the mat and then it ran away", "en", "a"),
        (1, "the cat sat on the mat and then it ran away", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n\r\x0b\x0c ", "en", None),
        (5, long, "en", "b"),
        (6, long, "en", "b"),
        (7, "word", None, "b"),
        (None, "le chat est sur la table et il mange du pain", "fr", "c"),
        (8, "Ünïcödé white space 😀 password=hunter2hunter2", "de", "c"),
    ]
    rows = [(*r, *["x"] * 9) for r in rows]
    names = "size target component_id spans severity language score rank block".split()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
