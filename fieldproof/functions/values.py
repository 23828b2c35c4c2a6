"""Typed values: what a VARIANT holds, and the form in which two values are compared.

Steps that use a value more than once are projections of their own, so that each value is made once and every step
stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold_digits_udf, is_ascii, normalise

#: Fixed value: plain decimals, with commas only where they group thousands rightly.
NUMBER = "^[+-]?(\\p{Nd}+|\\p{Nd}{1,3}(,\\p{Nd}{3})+)(\\.\\p{Nd}+)?$"


#: How the schema of a VARIANT of each kind begins.
SCHEMAS = {"object": "OBJECT", "array": "ARRAY", "text": "STRING", "boolean": "BOOLEAN"}


def schema_of(v: Column) -> Column:
    """The type of a VARIANT; OBJECT and ARRAY say nothing of what they hold. (``schema_of_variant`` spells out the inside by
    recursion, and ends an executor whose stack some 800 levels fill.)"""
    holds = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    return F.when(holds("map<string,variant>"), "OBJECT").when(holds("array<variant>"), "ARRAY").otherwise(F.schema_of_variant(v))


def is_kind(v: Column, name: str) -> Column:
    """Whether a VARIANT is an object, an array, a text or a boolean; null for no VARIANT."""
    return schema_of(v).startswith(SCHEMAS[name])


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def is_blank_text(v: Column) -> Column:
    """Not a text with anything but white space."""
    return ~F.coalesce(is_kind(v, "text") & text_of(v).rlike("[^\\s\\x1c-\\x1f\\x85]"), F.lit(False))


def base_rule(rule: Column) -> Column:
    """The base type of a rule given as a VARIANT: a text, or an object with ``type`` (default string)."""
    named = F.when(is_kind(rule, "object"), F.coalesce(F.try_variant_get(rule, "$.type", "string"), F.lit("string"))).otherwise(F.nullif(text_of(rule), F.lit("")))
    return F.when(rule.isNotNull() & ~F.is_variant_null(rule), F.split_part(F.coalesce(named, F.lit("string")), F.lit(" or "), F.lit(1)))


#: Of a plain decimal, what its shortest spelling lacks: a plus, commas, zeros before and after, and an empty fraction.
NEEDLESS = "^[+]|(?<=^[+-]?)[0,]+(?=[0-9])|,|[.]0*$|(?<=[.][0-9]{0,400}[1-9])0+$"


def canonical(number: Column) -> Column:
    """One spelling for equal decimals of any length: no plus, no needless zeros, no negative zero."""
    return F.regexp_replace(F.regexp_replace(number, NEEDLESS, ""), "^-0$", "0")


def whole_double(d: Column) -> Column:
    """The exact digits of a whole double below 10^38. A cast would go by its shortest spelling, and 1e23 is less than 10^23: so it is
    taken apart by powers of two, each part an integer."""
    size, high, low = F.abs(d), F.lit(float(1 << 64)), F.lit(float(1 << 32))
    top = F.floor(size / high).cast("bigint")
    rest = size - F.floor(size / high).cast("double") * high
    middle = F.floor(rest / low).cast("bigint")
    last = (rest - F.floor(rest / low).cast("double") * low).cast("bigint")
    exact = top.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + middle.cast("decimal(19,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)") + last.cast("decimal(19,0)")
    return F.concat(F.when(d < 0, "-").otherwise(""), exact.cast("string"))


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows. A filter on column ``name`` stays above this point; else the optimizer would write all that makes
    the column a second time, into a filter below."""
    return df.withColumn(name, F.explode_outer(F.array(F.col(name))))


def with_typed(df: DataFrame, values: dict[str, Column], rule: Column, unicode: bool = True) -> DataFrame:
    """Adds ``<name>_state`` and ``<name>_value`` for each named VARIANT. The state is null, invalid, text or number.

    ``rule`` is a base rule, null for none. Two values are the same where state and value are. Booleans, objects, arrays
    and infinite numbers are invalid. A number rule takes plain or rightly grouped decimals, and numbers as Python
    prints them, so none that it prints with an exponent. A text rule takes texts only. Without a rule texts stay what
    they are, and numbers are compared by value: integers as they are, others as doubles."""
    spare = lambda n, part: f"__{n}_{part}"
    of = lambda n, part: F.col(spare(n, part))

    def step(df: DataFrame, **made) -> DataFrame:
        return df.withColumns({spare(n, part): f(n) for part, f in made.items() for n in values})

    df = df.withColumn("__rule", rule).withColumn("__digits", F.coalesce(F.col("__rule").isin("number", "integer"), F.lit(False)))
    digits = F.col("__digits")
    df = step(df, schema=lambda n: schema_of(values[n]))
    df = step(
        df,
        text=lambda n: F.when(of(n, "schema") == "STRING", text_of(values[n])),
        # a whole decimal of fewer digits than a BIGINT was written with a point
        whole=lambda n: F.when(of(n, "schema").rlike("^(BIGINT$|DECIMAL\\((19|[23][0-9]),0\\))"), text_of(values[n])),
        double=lambda n: F.when(of(n, "schema").rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(values[n], "$", "double")),
    )
    if unicode:
        # texts beyond ASCII alone reach Python, all values of a row in one batch
        df = step(df, folded=lambda n: fold_digits_udf(F.when(~is_ascii(of(n, "text")), of(n, "text")), digits))
    df = step(df, text=lambda n: F.coalesce(of(n, "folded"), normalise(F.when(is_ascii(of(n, "text")), of(n, "text")), False)) if unicode else normalise(of(n, "text"), False))

    def spelled(n: str) -> Column:
        """Under a number rule: a text, an integer, or a double that needs no exponent."""
        d = of(n, "double")
        plain = (F.abs(d) < 1e16) & ((F.abs(d) >= 1e-4) | (d == 0))
        return F.when(digits, F.coalesce(of(n, "text"), of(n, "whole"), F.when(plain, d.cast("string").cast("decimal(38,21)").cast("string"))))

    df = step(df, spelled=spelled)
    df = step(df, number=lambda n: F.when(of(n, "spelled").rlike(NUMBER), canonical(of(n, "spelled"))))

    def state(n: str) -> Column:
        s, number, d = of(n, "schema"), of(n, "number"), of(n, "double")
        infinite = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
        return (
            F.when(s.isNull() | (s == "VOID") | ((s == "STRING") & of(n, "text").isNull()), "null")
            .when((s != "STRING") & of(n, "whole").isNull() & (d.isNull() | infinite), "invalid")
            .when(digits, F.when(number.isNotNull() & (~number.contains(".") | (F.col("__rule") != "integer")), "number").otherwise("invalid"))
            .when(s == "STRING", "text")
            .when(F.col("__rule").isNotNull(), "invalid")
            .otherwise("number")
        )

    df = df.withColumns({f"{n}_state": state(n) for n in values})

    def value(n: str) -> Column:
        # without a rule: doubles that are whole are spelled as the integers that they are, all others by their shortest spelling
        d = of(n, "double")
        whole = F.when((F.abs(d) < 9e18) & (d == F.floor(d)), d.cast("bigint").cast("string")).when((F.abs(d) >= 9e18) & (F.abs(d) < 1e38), whole_double(d))
        bare = F.coalesce(canonical(of(n, "whole")), whole, d.cast("string"))
        return F.when(F.col(f"{n}_state") == "text", of(n, "text")).when(F.col(f"{n}_state") == "number", F.coalesce(of(n, "number"), bare))

    parts = ("schema", "text", "whole", "double", "folded", "spelled", "number")
    return df.withColumns({f"{n}_value": value(n) for n in values}).drop("__rule", "__digits", *[spare(n, p) for n in values for p in parts])
