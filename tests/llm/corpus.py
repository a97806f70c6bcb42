"""A small corpus with the cases that every operator has to take: nulls, ties, repeats, very long texts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, shard int, digest string"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiouélnrst") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def line(k: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(k))

    shared = line(70)
    out: list[str | None] = [None, "", " ", "\n", "a", "A a", "a\tb  c\u00a0d", "日本語 ▁ \U0001f600 text", "<|endoftext|> <s> </s>", "x" * 3000, " ".join(["tick"] * 500), line(6000)]
    for i in range(n):
        body = "\n".join(line(rng.randint(3, 120)) for _ in range(rng.randint(1, 4)))
        if i % 7 == 0:
            body = f"{line(20)} {shared} {line(20)}"
        if i % 11 == 0:
            body += f"\n{shared}"
        out.append(body)
    out += [out[20], out[20], out[21] + " ", out[22].replace(" ", "  "), out[23] + " extra", out[24][:-3] + "zzz"]
    return out


def frame(spark: SparkSession, seed: int = 1) -> DataFrame:
    """Documents with extra columns of names that operators use inside, repeated rows, null ids and sources."""
    rows = []
    for i, t in enumerate(texts(seed)):
        source = None if i % 9 == 0 else f"src{i % 4}"
        rows.append((i, t, None if i % 5 == 0 else ["en", "de"][i % 2], source, None if i % 6 == 0 else len(t or ""), -1, "fp", 99, "d"))
    rows += [rows[30], rows[30], (None, "no id here", "en", "src1", 10, 0, "", 0, ""), (None, None, None, None, None, 0, "", 0, "")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
