import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def bytes_file():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_file():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def documents(spark):
    """doc_id, text with the awkward cases, and columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, 1, "x", 2.0, 3) for i, t in rows], "doc_id long, text string, piece int, score string, length double, fp int")

    return make


AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "word"), (5, "word"), (6, "the cat sat on the mat. " * 4000), (None, "no id here"), (7, "ß漢字\x00🎉 ▁  a"), (8, "a\n\n\nb\n")]


@pytest.fixture(scope="session")
def awkward():
    return AWKWARD
