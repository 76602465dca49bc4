"""Vector functions over array<double> columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 0.01


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where widths differ, a side is empty or null, or a norm is zero."""
    na, nb = norm(a), norm(b)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.coalesce(F.when(good, dot(a, b) / (na * nb)), F.lit(0.0))


def vector_defects(v: Column, dims: int = 0, tolerance: float = NORM_TOLERANCE) -> Column:
    """array<string> of what is wrong with a vector; dims 0: any width."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = norm(v)
    return F.array_compact(
        F.array(
            F.when(v.isNull() | (F.size(v) <= 0), "missing"),
            F.when((F.size(v) > 0) & (F.lit(dims) > 0) & (F.size(v) != dims), "wrong_width"),
            F.when((F.size(v) > 0) & bad, "not_finite"),
            F.when((F.size(v) > 0) & ~bad & (length == 0), "zero_norm"),
            F.when((F.size(v) > 0) & ~bad & (length > 0) & (F.abs(length - 1) > tolerance), "not_normalized"),
        )
    )


def shortest_decimal(x: float) -> str:
    """The shortest decimal that reads back as x: no exponent between 1e-4 and 1e21, else a two-digit exponent."""
    text = repr(float(x))
    if text in ("inf", "-inf", "nan"):
        return {"inf": "+Inf", "-inf": "-Inf", "nan": "NaN"}[text]
    sign, text = ("-", text[1:]) if text[0] == "-" else ("", text)
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    if not digits:
        return sign + "0"
    power = len(whole) - 1 + int(exponent or 0) if whole.strip("0") else int(exponent or 0) - (len(part) - len(part.lstrip("0")) + 1)
    digits = digits.rstrip("0")
    if power < -4 or power >= 21:
        return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{digits}"
    return sign + (digits.ljust(power + 1, "0") if len(digits) <= power + 1 else f"{digits[: power + 1]}.{digits[power + 1 :]}")


def embedding_hash_udf():
    """sha256 of the model, NUL, then each component's shortest decimal and NUL, and byte 1 at the vector's end."""
    import hashlib

    @F.pandas_udf("string")
    def embedding_hash(models: pd.Series, vectors: pd.Series) -> pd.Series:
        def one(model, vector):
            h = hashlib.sha256((model or "").encode() + b"\0")
            if vector is not None:
                h.update(b"".join(shortest_decimal(x).encode() + b"\0" for x in vector) + b"\x01")
            return h.hexdigest()

        return pd.Series([one(m, v) for m, v in zip(models, vectors, strict=True)])

    return embedding_hash


def retry_delay_ms(attempt: Column, base_ms: int = 500) -> Column:
    """base * 2^(attempt - 1); attempts below 1 count as 1."""
    return (F.lit(base_ms) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1)).cast("long")
