r"""JSON texts in one form: keys in order, `, ` and `: ` between, as few escapes and digits as there can be.

The JVM's VARIANT checks a text and puts its keys in order (of UTF-16 units), at any depth.
It doesn't know 1 from 1.0, so numbers pass through it as marked strings. Texts are cut at their
quotes, which leaves structure in the even parts and strings in the odd ones; no pass is recursive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: They stand for an escaped backslash and an escaped quote while a text is cut; no JSON has them as they are.
_BACKSLASH, _QUOTE = "\x01", "\x02"
#: A string that begins with this and a digit or a sign is a number; in all other strings it is doubled.
_MARK = r"\u0000"
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def _let(value: Column, of) -> Column:
    return F.transform(F.array(value), of)[0]


def _cut(text: Column) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"', -1)


def _uncut(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def real(text: Column) -> Column:
    """The shortest digits that are read as the same double; an exponent below 0.0001 and from 10^16 on."""

    def placed(digits: Column, point: Column) -> Column:
        """`0.digits` times 10^point."""
        n = F.length(digits)
        power = F.abs(point - 1).cast("string")
        exponent = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(point > 0, "e+").otherwise("e-"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), point), F.greatest(point, F.lit(1)), "0"), F.lit("."), F.when(n > point, F.substring(digits, point + 1, n)).otherwise("0"))
        return F.when((point > 16) | (point < -3), exponent).when(point > 0, whole).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))

    def written(d: Column) -> Column:
        said = F.abs(d).cast("string")
        mantissa = F.regexp_replace(said, "E.*", "")
        before = F.length(F.regexp_extract(mantissa, r"^0*([0-9]*)\.", 1)) - F.when(mantissa.startswith("0."), F.length(F.regexp_extract(mantissa, r"^0\.(0*)", 1))).otherwise(0)
        point = before + F.coalesce(F.regexp_extract(said, "E(.*)", 1).try_cast("int"), F.lit(0))
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+|0+$", "")

        def shortest(p: Column) -> Column:
            """Fewer digits, rounded, if they are read as the same: the JVM may write more than it takes."""
            all18 = F.rpad(p["digits"], 18, "0").cast("bigint")

            def rounded(k: Column) -> Column:
                unit = F.pow(F.lit(10), 18 - k).cast("bigint")
                keep = F.call_function("div", all18 + F.call_function("div", unit, F.lit(2)), unit).cast("string")
                same = F.concat(keep, F.lit("e"), (p["point"] - k).cast("string")).cast("double") == F.abs(d)
                # A carry may bring a digit more.
                return F.when(same, F.struct(F.regexp_replace(keep, "0+$", "").alias("digits"), (p["point"] + F.length(keep) - k).alias("point")))

            # Subnormal numbers have fewer digits than fifteen to tell them apart.
            tried = F.filter(F.transform(F.sequence(F.when(F.abs(d) < 2.3e-308, 1).otherwise(15), F.lit(17)), rounded), lambda x: x.isNotNull())
            return F.when((F.length(p["digits"]) > 15) | (F.abs(d) < 2.3e-308), F.coalesce(F.try_element_at(tried, F.lit(1)), p)).otherwise(p)

        found = _let(F.struct(digits.alias("digits"), point.cast("int").alias("point")), shortest)
        return F.concat(F.when(F.startswith(d.cast("string"), F.lit("-")), "-").otherwise(""), F.when(d == 0, "0.0").when(F.abs(d) == float("inf"), "Infinity").otherwise(_let(found, lambda p: placed(p["digits"], p["point"]))))

    return _let(text.cast("double"), written)


def canonical_json(text: Column) -> Column:
    """A JSON text in its one form. Null for a text that is none, or in which an object has a key twice."""
    marked = F.transform(
        _cut(text),
        lambda part, i: F.when(i % 2 == 0, F.regexp_replace(part, _NUMBER, r'"\\u0000$1"')).otherwise(F.replace(part, F.lit(_MARK), F.lit(_MARK * 2))),
    )
    ordered = F.to_json(F.try_parse_json(_uncut(F.array_join(marked, '"'))))

    def shown(part: Column, i: Column) -> Column:
        between = F.replace(F.replace(part, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        number = F.substring(part, F.lit(len(_MARK) + 1), F.length(part))
        value = F.when(part.rlike(r"^\\u0000-?[0-9.]+[.eE]") | part.rlike(r"^\\u0000-?[0-9]+[eE]"), real(number)).otherwise(F.when(number == "-0", "0").otherwise(number))
        # Control characters that have no letter of their own: the digits of their escapes are small.
        plain = F.replace(part, F.lit(_MARK * 2), F.lit(_MARK))
        for c in [*range(0x0A, 0x10), *range(0x1A, 0x20)]:
            plain = F.replace(plain, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
        return F.when(i % 2 == 0, between).when(part.rlike(r"^\\u0000[-0-9]"), value).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))

    sound = F.try_parse_json(text).isNotNull()
    return F.when(sound, _uncut(F.array_join(F.transform(_cut(ordered), shown), "")))


def json_fingerprint(text: Column) -> Column:
    """A digest of a JSON value: equal for texts that differ in spaces, escapes or the order of keys alone."""
    return F.sha2(canonical_json(text), 256)
