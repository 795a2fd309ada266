"""Validators of matched values, as boolean columns.  None of them runs Python on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A validator gets the value and its match, which has the text around it where the rule asks for context.
Validator = Callable[[Column, Column], Column]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def chars(value: Column) -> Column:
    """Single characters, without the empty strings that a split leaves."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def before(match: Column, n: int) -> Column:
    """Up to ``n`` characters that end where the value starts."""
    return F.right(match["head"], F.lit(n))


def luhn_ok(value: Column) -> Column:
    d = digits(value)
    return F.char_length(d).between(13, 19) & ~d.rlike(r"^([0-9])\1*$") & F.call_function("luhn_check", d)


def iban_ok(value: Column) -> Column:
    s = F.upper(F.regexp_replace(value, r"[\s\x{00A0}]", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.char_length(s)), F.substring(s, 1, 4))
    number = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(chars(moved), F.lit(0), lambda a, c: (a * F.when(c <= "9", 10).otherwise(100) + number(c)) % 97)
    return s.rlike(r"^[A-Z0-9]{15,34}$") & (rest == 1)


def phone_ok(value: Column) -> Column:
    return F.char_length(digits(value)).between(10, 15)


def nanp_phone_ok(value: Column) -> Column:
    d = digits(value)
    return d.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$") & ~d.rlike(r"^([0-9])\1+$")


def aws_access_key_ok(value: Column) -> Column:
    return F.translate(value, " \t", "").rlike(r"^(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\z")


def basic_auth_ok(value: Column) -> Column:
    s = F.regexp_replace(value, r"\s+", "")
    shaped = s.rlike(r"^[A-Za-z0-9+/]+={0,2}\z") & (F.char_length(s) % 4 == 0)
    return F.when(shaped, F.coalesce(F.try_to_binary(s, F.lit("base64")).cast("string").contains(":"), F.lit(False))).otherwise(F.lit(False))


def ssn_ok(value: Column) -> Column:
    return digits(value).rlike(r"^(?!000|666|9[0-9]{2})[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def ssn_context_ok(value: Column, match: Column) -> Column:
    cued = before(match, 32).rlike(r"(?i)(?<![0-9A-Za-z_])(?:ssn|social\s+security)(?![0-9A-Za-z_])\s*+[:#-]?\s*\z")
    return ssn_ok(value) & (value.rlike("[ -]") | match["alone"] | cued)


def ipv4_ok(value: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return value.rlike(rf"^{octet}(?:\.{octet}){{3}}\z") & (value != "0.0.0.0")


def ipv4_in_context_ok(value: Column, match: Column) -> Column:
    return ipv4_ok(value) & ~before(match, 24).rlike(r"(?i)(?:(?<![0-9A-Za-z_])version|(?<![0-9A-Za-z_])release|(?<![0-9A-Za-z_])v)\s*\z")


def ipv6_ok(value: Column) -> Column:
    """Groups of 1 to 4 hex digits: eight, or up to seven around one ``::``; a zone and a dotted tail may follow."""
    v = F.regexp_replace(value, r"%[A-Za-z0-9_.-]+\z", "")
    tail = F.regexp_extract(v, r"^.*:((?:[0-9]{1,3}\.){3}[0-9]{1,3})\z", 1)
    plain = F.regexp_replace(v, r":(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z", ":0:0")
    groups = F.filter(F.split(plain, ":"), lambda g: g != "")
    good = F.forall(groups, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z"))
    halves = F.size(F.split(plain, "::", -1))
    colons = F.char_length(plain) - F.char_length(F.replace(plain, F.lit(":")))
    stray = plain.rlike(r"(?:^|[^:]):\z|^:(?!:)|:::")
    return ((tail == "") | ipv4_ok(tail)) & (colons >= 2) & good & ~stray & (((halves == 2) & (F.size(groups) <= 7)) | ((halves == 1) & (F.size(groups) == 8)))


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for an empty value.  Rounded to 9 places, as the order of summing is left open."""
    n = F.char_length(value)
    parts = F.transform(F.array_distinct(chars(value)), lambda c: (n - F.char_length(F.replace(value, c))) / n)
    bits = F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, F.round(bits, 9)).otherwise(F.lit(0.0))


def looks_random(value: Column) -> Column:
    v = F.regexp_replace(value, "^=+|=+$", "")
    mixed = v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & ~v.rlike("[A-Za-z]{12,}")
    return F.when((F.char_length(v) >= 20) & mixed, shannon_entropy(v) >= 3.7).otherwise(F.lit(False))


def looks_base64(value: Column) -> Column:
    """Padded base64 of whole groups, which is data rather than a key."""
    return value.rlike(r"^[A-Za-z0-9+/]+={1,2}\z") & (F.char_length(value) % 4 == 0)


def possible_secret_ok(value: Column) -> Column:
    return ~looks_base64(value) & looks_random(value)


def not_masked(value: Column) -> Column:
    return (value != "") & ~value.rlike(r"^[*•●·xX._\-]+\z")


def secret_value_ok(value: Column) -> Column:
    """Neither a link or a placeholder, nor masked, nor a word that stands for no value."""
    low = F.lower(value)
    placeholder = low.rlike(r"^(?:https?://|\$\{|\$\(|<|\{\{|%)")
    return ~placeholder & not_masked(value) & ~low.isin("none", "null", "true", "false", "undefined", "required")


def secret_like_chunk(chunk: Column) -> Column:
    """Whether what follows a secret behind a space looks like more of it rather than like a word."""
    cases = chunk.rlike(r"\p{Ll}") & chunk.rlike(r"\p{Lu}") & ~chunk.rlike(r"^\p{Lu}\p{Ll}+\z")
    return (F.char_length(chunk) >= 3) & (chunk.rlike(r"[^\p{L}\p{M}]") | cases)


def valid_domain(domain: Column) -> Column:
    label = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?"
    return (F.char_length(domain) <= 255) & domain.rlike(rf"^(?:{label}\.)+{label}\z") & ~domain.rlike(r"\..\z")


def more_of_secret(tail: Column, most: int = 4) -> Column:
    """How many characters of the text behind a secret, up to ``most`` chunks of it, look like more of the secret."""
    piece = r""" {1,2}[^\s"',;]+"""
    pieces = F.regexp_extract_all(F.regexp_extract(tail, f"^(?:{piece}){{0,{most}}}", 0), F.lit(piece), F.lit(0))
    start = F.struct(F.lit(0).alias("size"), F.lit(True).alias("open"))

    def step(a: Column, p: Column) -> Column:
        more = a["open"] & secret_like_chunk(F.ltrim(p))
        return F.struct(F.when(more, a["size"] + F.char_length(p)).otherwise(a["size"]).alias("size"), more.alias("open"))

    return F.aggregate(pieces, start, step, lambda a: a["size"])
