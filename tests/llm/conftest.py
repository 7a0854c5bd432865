import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "kept boolean, bucket string, ids string, score double, part int, block int")

LOREM = ("the cat sat on the mat and the dog ran to the house in the rain with a friend of the "
         "family who was not at home that day because of the long road to the sea and back again "
         "over the hills far away from the town where they had lived for many years before").split()


def words(seed: int, n: int) -> str:
    """Deterministic words that differ between seeds."""
    return " ".join(f"{LOREM[(seed * 31 + k * 7) % len(LOREM)]}{(seed * 97 + k * k) % 53}"
                    for k in range(n))


def odd_rows():
    base = words(1, 120)
    texts = {
        0: base, 1: base, 2: base.replace("the", "THE", 1), 3: None, 4: "", 5: " \t\n ",
        6: "word", 7: "two words", 8: words(2, 60) + " " + base, 9: "a " * 3000,
        10: "x" * 5000, 11: "日本語のテキスト é ﬁ \u0085   <|endoftext|> <|STARTOFTEXT|>",
        12: words(3, 4000), 13: base + " " + words(4, 5), 14: "12345 !!! ###",
        15: "line\nline\nline\n\nother line\nline", 16: words(5, 49), 17: words(5, 50),
        18: words(5, 51),
    }
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None if t is None else len(t))
            for i, t in texts.items()]
    return rows + [rows[0], rows[7]]             # repeated rows


@pytest.fixture(scope="session")
def odd(spark):
    extra = (True, "b", "x", 0.5, 1, 2)
    return spark.createDataFrame([r + extra for r in odd_rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from marketgrid.llm.common import ship_package
    ship_package(spark)
