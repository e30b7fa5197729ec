DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, digest string, n int"


def documents(spark, texts, start=0):
    """A table of documents with extra columns whose names the operators use too."""
    rows = [(start + i, t, "en" if i % 2 else None, "src" if i % 3 else None, len(t or ""), "x", None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed=0):
    """n words that hardly repeat in runs."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))
