"""JSON in and out, with ECMAScript's coercion of a message to a string, as column functions.

Messages are coerced by Spark's VARIANT functions, arrays of any depth too. Numbers are spelled as
ECMAScript spells doubles. Of repeated names in an object the last one counts, once
allow_repeated_keys was called on the session.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import bound

# Body limits in bytes.
RULE_SERVER_LIMIT, RELAY_LIMIT = 1024 * 1024, 100 * 1024


def within_limit(body: Column, limit: int = RULE_SERVER_LIMIT) -> Column:
    return F.octet_length(body) <= limit


def message_field(body: Column) -> Column:
    """The message of a body as a plain JSON string field; NULL if absent or malformed."""
    return F.from_json(body, "message string")["message"]


def allow_repeated_keys(spark: SparkSession) -> None:
    """JSON objects may repeat a name; the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def js_number(x: Column) -> Column:
    """A double as ECMAScript spells it: plain from 1e-6 up to 1e21, else with an exponent."""

    def parts(java: Column) -> Column:
        """The digits without a point, how many are ahead of the point, and the power of ten."""
        digits = F.split_part(java, F.lit("E"), F.lit(1))
        power = F.coalesce(F.nullif(F.split_part(java, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
        return F.struct(F.replace(digits, F.lit("."), F.lit("")).alias("bare"), F.length(F.split_part(digits, F.lit("."), F.lit(1))).alias("whole"), power.alias("power"))

    def scaled(p: Column) -> Column:
        """Significant digits, and the power of ten that 0.digits is multiplied by."""
        ahead = F.ltrim(p["bare"], F.lit("0"))
        return F.struct(F.rtrim(ahead, F.lit("0")).alias("sig"), (p["whole"] + p["power"] - F.length(p["bare"]) + F.length(ahead)).alias("point"))

    def shortest(v: Column) -> Column:
        """The fewest digits that read back as the same double, the nearest of them first: Java's own may be more."""

        def tried(k: Column) -> Column:
            lead = F.substring(v["sig"], F.lit(1), k)
            above = (lead.cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
            up = F.substring(v["sig"], k + 1, F.lit(1)) >= "5"
            reads = lambda d: F.concat(d, F.lit("E"), (v["point"] - k).cast("string")).cast("double") == F.abs(x)
            both = F.when(up, F.array(above, lead)).otherwise(F.array(lead, above))
            # 9 and one is 10: a digit more ahead of the point
            return F.transform(F.filter(both, reads), lambda d: F.struct(F.rtrim(d, F.lit("0")).alias("sig"), (v["point"] + F.length(d) - k).alias("point")))

        return F.get(F.flatten(F.transform(F.sequence(F.lit(1), F.length(v["sig"])), tried)), F.lit(0))

    def spelled(v: Column) -> Column:
        sig, point = v["sig"], v["point"]
        k = F.length(sig)
        tail = F.when(k > 1, F.concat(F.lit("."), F.substring(sig, F.lit(2), k))).otherwise(F.lit(""))
        return (
            F.when((point >= k) & (point <= 21), F.rpad(sig, point, "0"))
            .when((point > 0) & (point <= 21), F.concat(F.substring(sig, F.lit(1), point), F.lit("."), F.substring(sig, point + 1, k)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), sig))
            .otherwise(F.concat(F.substring(sig, F.lit(1), F.lit(1)), tail, F.lit("e"), F.when(point > 0, F.lit("+")).otherwise(F.lit("-")), F.abs(point - 1).cast("string")))
        )

    plain = bound(bound(bound(bound(F.abs(x).cast("string"), parts), scaled), shortest), spelled)
    return F.when(x == 0, F.lit("0")).when(x < 0, F.concat(F.lit("-"), plain)).otherwise(plain)


#: Spark's JSON parser refuses deeper nesting.
DEEPEST = 1000


def _scalar(v: Column) -> Column:
    """A value other than an array as a string: NULL if it can't become one. Falsy values aren't special here."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    odd = F.schema_of_variant(F.try_variant_get(v, "$.toString", "variant")).isNotNull()
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), bound(F.try_variant_get(v, "$", "double"), js_number))
        .when(kind.startswith("OBJECT"), F.when(odd, F.lit(None).cast("string")).otherwise(F.lit("[object Object]")))
        .otherwise(text)
    )


def _joined(array: Column) -> Column:
    """An array as a string. Arrays in it are joined by the same commas, so it is its leaves in order; an empty array is an empty leaf.

    One level of nesting is opened after another, as many as the text has brackets.
    """
    brackets = F.regexp_count(F.to_json(array), F.lit(r"\["))

    def opened(x: Column) -> Column:
        inner = F.try_variant_get(x, "$", "array<variant>")
        return F.when(~F.coalesce(F.schema_of_variant(x).startswith("ARRAY"), F.lit(False)), F.array(x)).when(F.size(inner) > 0, inner).otherwise(F.array(F.parse_json(F.lit('""'))))

    leaves = F.aggregate(F.sequence(F.lit(1), F.least(brackets, F.lit(DEEPEST))), F.array(array), lambda all_, _: F.flatten(F.transform(all_, opened)))
    return bound(F.transform(leaves, _scalar), lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, ",")))


def decode_message(body: Column) -> Column:
    """Falsy values give '', others their string form; NULL if the body is malformed or the message can't become a string."""
    v = F.try_parse_json(body)
    m = F.try_variant_get(v, "$.message", "variant")
    kind = F.schema_of_variant(m)
    text = F.try_variant_get(v, "$.message", "string")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.try_variant_get(v, "$.message", "double")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(m.isNull() | (kind == "VOID"), F.lit(""))
        .when(number & (value == 0), F.lit(""))
        .when(number, bound(value, js_number))
        .when((kind == "BOOLEAN") & (text == "false"), F.lit(""))
        .when(kind.startswith("ARRAY"), bound(m, _joined))
        .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
        .otherwise(text)
    )


def missing(body: Column) -> Column:
    """True for a request without a body."""
    return F.coalesce(F.octet_length(body), F.lit(0)) == 0


def malformed(body: Column) -> Column:
    """True for a body that isn't one JSON object or array, with white space at most around it.

    Spark's parser stops after a value. One that stands alone is right both in an array and in an object,
    while whatever follows it breaks one of them.
    """
    kind = F.schema_of_variant(F.try_parse_json(body))
    alone = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"_":'), body, F.lit("}"))).isNotNull()
    return ~F.coalesce((kind.startswith("OBJECT") | kind.startswith("ARRAY")) & alone, F.lit(False))


def uncoercible(body: Column) -> Column:
    """True if the message is an object whose toString isn't callable."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.message.toString", "variant")).isNotNull(), F.lit(False))


def json_text(c: Column) -> Column:
    """A string as JSON.stringify spells it: short escapes where there are any, else lower-case digits; NULL gives null."""
    short = {"\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t"}
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\" + short.get(chr(code), f"u{code:04x}")))
    plain = F.when(F.rlike(c, F.lit(r'[\x00-\x1f"\\]')), escaped).otherwise(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def encode_reply(reply: Column) -> Column:
    """{"reply": ...}; a NULL reply is undefined in the reply record, so the name is left out."""
    return F.when(reply.isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"reply":'), json_text(reply), F.lit("}")))


def encode_request(message: Column) -> Column:
    return F.when(message.isNull(), F.lit("{}")).otherwise(F.concat(F.lit('{"message":'), json_text(message), F.lit("}")))


def decode_reply(response: Column) -> Column:
    return F.from_json(response, "reply string")["reply"]
