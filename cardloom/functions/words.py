"""Words and word shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.steps import step

# Accented letters and the letters they fold to, position by position.
ACCENTED = "áàâäãåāăąçćčďđéèêëēėęěíìîïīįłñńňóòôöõøōőřśšťúùûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorsstuuuuuuuyyzzz"


def folded(text: Column) -> Column:
    """Lower case, without accents; combining marks are dropped."""
    return F.translate(F.regexp_replace(F.lower(text), r"[̀-ͯ]", ""), ACCENTED, PLAIN)


def words(text: Column) -> Column:
    """Folded runs of letters and digits; null gives null."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, keep: list[str], text: str, size: int = 5) -> DataFrame:
    """``keep``, the number of words ``_words`` and the 64-bit hashes ``_shingles`` of all runs of ``size`` words, in order.

    Texts with fewer words, empty ones and nulls give no row. Words are hashed once; a run's hash combines their hashes.
    """
    out = step(df, keep, words(F.col(text)).alias("_tokens"))
    out = step(out.where(F.size("_tokens") >= size), keep, F.transform("_tokens", lambda w: F.xxhash64(w)).alias("_hashed"))
    runs = F.transform(F.sequence(F.lit(0), F.size("_hashed") - size), lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(size)]))
    return step(out, keep, F.size("_hashed").alias("_words"), runs.alias("_shingles"))
