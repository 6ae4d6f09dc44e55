"""Column functions over the ninth column of GFF3 and GTF rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes whose values are lists.
LISTS = ("Parent", "Alias", "Note", "Dbxref", "Ontology_term")


def tokens(text: Column) -> Column:
    """Ordered array<struct<key, value, separator, quoted>>.

    A part is 'key=value' if an equals sign comes before its first blank, else 'key value';
    a lone word is a flag with no value. Quotes around a value go and are remembered."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))

    def token(x):
        equals, blank = F.instr(x, "="), F.instr(x, " ")
        by_equals = (equals > 0) & ((blank == 0) | (equals < blank))
        at = F.when(by_equals, equals).when(blank > 0, blank).otherwise(F.length(x) + 1)
        value = F.trim(F.substring(x, at + 1, F.length(x)))
        quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        sign = F.when(by_equals, F.lit("=")).when(blank > 0, F.lit(" ")).otherwise(F.lit(""))
        return F.struct(F.trim(F.substring(x, F.lit(1), at - 1)).alias("key"), bare.alias("value"), sign.alias("separator"), quoted.alias("quoted"))

    return F.transform(parts, token)


def values_of(toks: Column, key: str) -> Column:
    """All values of a key, in order."""
    return F.transform(F.filter(toks, lambda t: t["key"] == key), lambda t: t["value"])


def first_of(toks: Column, key: str) -> Column:
    return F.get(values_of(toks, key), F.lit(0))


def last_of(toks: Column, key: str) -> Column:
    found = values_of(toks, key)
    return F.get(found, F.size(found) - 1)


def render_tokens(toks: Column) -> Column:
    """The text form of tokens; '.' if there are none."""

    def one(t):
        value = F.when(t["quoted"], F.concat(F.lit('"'), t["value"], F.lit('"'))).otherwise(t["value"])
        return F.concat(t["key"], t["separator"], value)

    return F.when(F.size(toks) == 0, F.lit(".")).otherwise(F.concat(F.array_join(F.transform(toks, one), "; "), F.lit(";")))


def gtf_attributes(gene: Column, transcript: Column | None = None, **more: Column) -> Column:
    """gene_id and transcript_id, then further keys in the order given; nulls are left out."""

    def pair(key, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'{key} "'), value, F.lit('";')))

    own = [pair("gene_id", gene)] + ([pair("transcript_id", transcript)] if transcript is not None else [])
    return F.concat_ws(" ", *own, *[pair(k, v) for k, v in more.items()])


def escape(value: Column) -> Column:
    """Percent-encoding for GFF3: letters, digits and : . _ + - ~ stay."""
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("%3A", ":"), ("%2B", "+"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def unescape(value: Column) -> Column:
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def gff3_attributes(**pairs: Column) -> Column:
    """key=value pairs in the order given; an array value is a comma list; empty ones are left out."""
    parts = []
    for key, value in pairs.items():
        text = F.concat(F.lit(f"{key}="), escape(value.cast("string")))
        parts.append(F.when(value.isNotNull() & (value.cast("string") != ""), text))
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))


def gff3_list(key: str, values: Column) -> Column:
    """A list attribute: items escaped one by one, joined by commas."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{key}="), F.array_join(F.transform(values, escape), ",")))
