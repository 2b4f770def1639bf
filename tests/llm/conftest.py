import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and columns that clash with the operators' own."""

    def make(texts, langs=None):
        rows = []
        for i, text in enumerate(texts):
            rows.append((i, text, (langs or ["en"] * len(texts))[i], "s", 0, "x", 1, [1], "h", -1))
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "words string, bits int, starts array<int>, host string, component_id int"
        )
        return spark.createDataFrame(rows, schema)

    return make


def same_rows(frame, rows):
    """Do the frame's rows equal the given ones, in any order?"""
    key = repr
    return sorted(map(tuple, frame.collect()), key=key) == sorted(map(tuple, rows), key=key)
