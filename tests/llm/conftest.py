import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, monkeypatch, tmp_path):
    """Stored tables of a test go to its own folder."""
    from gradus.sources import staging

    monkeypatch.setattr(staging, "shared_dir", lambda session: str(tmp_path / "shared"))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    long = " ".join(f"word{i % 977} other{i % 1013}" for i in range(20000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, same, "en", "a"), (2, same + " thirteen", "en", "b"), (2, same + " thirteen", "en", "b"), (3, "", "en", None),
        (4, None, None, "a"), (None, "a row without id but with quite enough words to be read as a document", None, None),
        (5, long, "en", "a"), (6, " \n\t ", "fr", "c"), (7, "it's <|endoftext|> x\ny  z", "fr", "c"), (8, "漢字 é ü 😀", "fr", "c"),
        (9, "tiny", "en", "a"), (10, long[:-9], "en", "b"),
    ]
    return spark.createDataFrame(
        [(*r, len(r[1]) if r[1] else None, "n", 0, 1) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, part int, token int")
