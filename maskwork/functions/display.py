"""How labels and values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keep their capitals, and words with a spelling of their own.
ACRONYMS = ["IP", "AWS", "URL", "SSN", "US", "IBAN", "JWT", "MAC", "QR", "AI", "API"]
SPELLED = {"GITHUB": "GitHub", "HUGGINGFACE": "Hugging Face"}


def pretty_label(label: Column) -> Column:
    def word(w: Column) -> Column:
        out = F.when(w.isin(ACRONYMS), w)
        for plain, shown in SPELLED.items():
            out = out.when(w == plain, shown)
        return out.otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w)))))

    return F.array_join(F.transform(F.split(label, "_"), word), " ")


def mask_preview(value: Column) -> Column:
    """The first characters of a value and dots: none of it below 8 characters, two below 20, four from there on."""
    t = F.trim(F.coalesce(value, F.lit("")))
    n = F.char_length(t)
    keep = F.when(n < 8, 0).when(n < 20, 2).otherwise(4)
    dots = F.when(n < 8, n).otherwise(F.least(F.lit(8), n - keep))
    return F.concat(F.substring(t, F.lit(1), keep), F.repeat(F.lit("•"), dots))
