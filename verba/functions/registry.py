"""SQL names of the scalar functions and table functions (§2.11 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verba.functions import textnorm
from verba.runtime import prepare


def register(spark: SparkSession) -> list[str]:
    """Register ``vb_*`` functions in a session; all run on Arrow batches."""
    prepare(spark)

    def batched(f):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x))

        return run

    scalars = {
        "vb_orthography": ("string", lambda x: textnorm.orthography(textnorm.PREREFORM, x)),
        "vb_normalize_word": ("string", lambda x: textnorm.normalize_word(textnorm.PREREFORM, x)),
        "vb_case_of": ("string", textnorm.case_of),
        "vb_reform_variants": ("array<string>", textnorm.reform_variants),
    }
    for name, (kind, f) in scalars.items():
        spark.udf.register(name, F.pandas_udf(batched(f), kind))

    @F.udtf(returnType="idx: int, raw: string, form: string, start: int, end: int, rune_start: int, rune_end: int, kind: string, script: string, case: string, dotted: boolean, sentence_end: boolean")
    class Tokens:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, t in enumerate(textnorm.tokenize(textnorm.PREREFORM, text or "")):
                yield (i, *t)

    spark.udtf.register("vb_tokens", Tokens)
    return [*scalars, "vb_tokens"]
