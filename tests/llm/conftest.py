import pytest

WORDS = "alpha Beta gamma DELTA eps zeta eta Theta iota kappa".split()


def make_texts():
    """Nulls, empties, white space of all kinds, ties, repeats, long words and long texts."""
    body = [" ".join(WORDS[(i * j + j) % 10] + str(i % 7) for j in range(12 + i)) for i in range(30)]
    return [None, "", "   \t\n", "one", "one two", "one two three", "ONE two\x0bTHREE x", "a" * 30000, " ".join(["same"] * 300),
            "line one\nline one\n\nline two\nline one", "émigré ñandú 漢字 😀 done " * 4, *body, body[3], body[3], body[4] + " extra",
            "mail a.b+c@x-1.example.co_x@y.zz z, 1.2.3.4.5.6.7.8 and 300.1.1.1 or 001.02.3.0255",
            "card 4111 1111 1111 1111, 4111-1111-1111-1112 tel +1 (988) 555-2485) +12 345 and 😀 bob@site.example.org",
            " ".join(body) * 3, "x<|endoftext|>y " * 3]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """A documents table with nulls in every column, repeated rows and columns whose names clash with internal ones."""
    rows = [(i if i != 5 else None, t, [None, "en", "de"][i % 3], [None, "b", "a", "Z", "é"][i % 5], None if i % 4 == 0 else i, f"x{i}", i)
            for i, t in enumerate(texts)]
    rows += [rows[12], rows[12]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, key long")
    path = str(tmp_path_factory.mktemp("docs"))
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
