"""Number, time and id text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number_text(x: Column) -> Column:
    """Text of a double the way a JSON writer prints it: 2, 0.5, 0.0005, 1e+21.

    The fewest digits that read back as the same double, for every finite one. They are taken
    from the cast to text, which has at times a digit or two more than needed; so the value with one
    digit less, and again, is kept where it reads back.
    """
    size = F.abs(x.cast("double"))
    text = size.cast("string")
    mantissa, tens = F.substring_index(text, "E", 1), F.when(text.contains("E"), F.substring_index(text, "E", -1)).otherwise("0").cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", "")
    parsed = F.struct(F.concat(whole, part).try_cast("bigint").alias("n"), (tens - F.length(part)).alias("e"))

    def shorter(p: Column) -> Column:
        down = ((p["n"] - p["n"] % 10).cast("decimal(20,0)") / F.lit(10).cast("decimal(2,0)")).cast("bigint")
        near, far = F.when(p["n"] % 10 > 5, down + 1).otherwise(down), F.when(p["n"] % 10 > 5, down).otherwise(down + 1)
        out = p
        for n in (far, near):
            same = F.concat(n.cast("string"), F.lit("E"), (p["e"] + 1).cast("string")).try_cast("double") == size
            out = F.when(same, F.struct(n.alias("n"), (p["e"] + 1).alias("e"))).otherwise(out)
        return out

    def formatted(p: Column) -> Column:
        digits = F.regexp_replace(p["n"].cast("string"), "(?<=[0-9])0+$", "")
        point = F.length(p["n"].cast("string")) + p["e"]  # digits before the point
        n = F.length(digits)
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 40))).otherwise(F.lit(""))
        power = F.concat(
            F.substring(digits, 1, 1), rest, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
        return (
            F.when(p["n"] == 0, F.lit("0"))
            .when((point > 21) | (point < -5), power)
            .when(point >= n, F.rpad(digits, point, "0"))
            .when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )

    chosen = F.transform(F.transform(F.transform(F.array(parsed), shorter), shorter), formatted)[0]
    return F.when(x < 0, F.concat(F.lit("-"), chosen)).otherwise(chosen)


def iso_millis(ts: Column) -> Column:
    """``2024-01-31T00:00:00.000Z`` for a timestamp (UTC session)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_from_ms(ms: Column) -> Column:
    return iso_millis(F.timestamp_millis(ms))


def round4(x: Column) -> Column:
    """Round to four places, ties upward."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def rate4(count: Column, seconds: int) -> Column:
    """count / seconds to four places, half up, in integer arithmetic."""
    doubled = count.cast("bigint") * F.lit(20000).cast("bigint") + F.lit(seconds)
    return F.floor(doubled / F.lit(2 * seconds)) / F.lit(10000.0)


def uuid_text(digest: Column) -> Column:
    """A 32-digit hex digest in 8-4-4-4-12 form."""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def utf16_length(s: Column) -> Column:
    """String length in UTF-16 code units, the unit of the length limits."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def anomaly_id(rule_id: Column, event_id: Column) -> Column:
    """Id fixed by rule and event, so that a retried write yields the same row."""
    return uuid_text(F.md5(F.concat(rule_id, F.lit("|"), event_id)))
