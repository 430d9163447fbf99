"""Validators a rule can name: a matched value in, a boolean column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, luhn_valid


def _jwt_claim(value: Column, name: str) -> Column:
    """A top-level claim of a token's payload, NULL where it cannot be read."""
    segment = F.translate(F.split_part(value, F.lit("."), F.lit(2)), "-_", "+/")
    padded = let(
        segment,
        lambda s: F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), F.lit("=")),
    )
    payload = F.to_char(F.try_to_binary(padded, F.lit("base64")), F.lit("utf-8"))
    return F.get_json_object(payload, f"$.{name}")


def _is_service_role(value: Column) -> Column:
    return F.coalesce(_jwt_claim(value, "role") == "service_role", F.lit(False))


def jwt_service_role(value: Column) -> Column:
    return _is_service_role(value)


def jwt_non_expiring(value: Column) -> Column:
    return ~_is_service_role(value) & _jwt_claim(value, "exp").isNull()


def jwt_expiring(value: Column) -> Column:
    return ~_is_service_role(value) & _jwt_claim(value, "exp").isNotNull()


#: Register a function here to make its name usable as ``validate`` in a pack.
VALIDATORS: dict[str, Callable[[Column], Column] | None] = {
    "luhn": luhn_valid,
    "none": None,
    "jwt_service_role": jwt_service_role,
    "jwt_non_expiring": jwt_non_expiring,
    "jwt_expiring": jwt_expiring,
}
