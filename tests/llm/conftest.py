import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, n int, words string, copies long"


def corpus(seed: int = 5) -> list[tuple]:
    """Few texts with every case: copies, near copies, shared passages and lines, one word, white space, none, ties."""
    r = random.Random(seed)
    vocab = ["der", "und", "nicht", "Haus", "the", "of", "and", "house", "river", "x1", "ünder", "naïve", "日本", "Zeit", "stone", "that", "is", "for"]
    vocab += ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) + ("\n" if r.random() < 0.06 else "") for _ in range(n))
    passage, line = text(60).replace("\n", " "), "this line stands in many documents of the table"
    base = text(150)
    out = [text(r.randrange(1, 260)) for _ in range(40)]
    for k in range(14):
        w = base.split(" ")
        w[r.randrange(len(w))] = f"new{k}"
        out.append(" ".join(w))
    out += [base, base, base.upper(), passage + " " + text(20), text(30) + " " + passage, f"{text(20)}\n{line}\n{text(9)}", f"{line}\nother {text(12)}", line.replace("many", "mony"), line.replace("table", "tables.")]
    out += ["", " \n\t ", "one", "two words", "a b c d", "a b c d", "tick " * 200, "y" * 9000, "Mail me: a.b+c@ex-am.ple.com, +1 (555) 555-1234 or 4111 1111 1111 1111 at 10.0.0.1.", "<|endoftext|> 's 'll 12", None, None]
    return [(i * 3, t, r.choice(["en", "de", None]), "big" if i % 3 else r.choice(["s1", "s2", None]), len(t or ""), "k", 1, 2, "w", 9) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
