"""The SQL of op3_line_dedup against the query, on lines that differ by few characters of one to four bytes."""

import random

import duckdb

from tidewatch.llm import queries


def test_line_dedup_sql(spark, tmp_path):
    rng = random.Random(5)
    letters = "abc déß日本語𝔘 .7"
    base = ["".join(rng.choice(letters) for _ in range(n)) for n in (19, 20, 21, 30, 60, 200)] + ["x" * 22, "日" * 40, " \t ", ""]

    def moved(line: str) -> str:
        for _ in range(rng.randrange(5)):
            i = rng.choice((0, len(line), rng.randrange(len(line) + 1)))
            line = rng.choice((line[:i] + line[i + 1 :], line[:i] + rng.choice(letters) + line[i:], line[:i] + rng.choice(letters) + line[i + 1 :]))
        return line

    rows = [(i, "\n".join(moved(rng.choice(base)) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "\n\n"), (153, rows[0][1]), (None, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.OP3_SQL).fetchall()
    got = [tuple(r) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] for r in got) > 100
