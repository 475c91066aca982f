"""Names and labels: readable words, entry classification, file-safe snapshot labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark a path as a test.
TEST_MARKS = ("test", "spec", "__tests__", ".test.", ".spec.", "_test.", "_spec.")


def camel_words(name: Column) -> Column:
    """Words of a camelCase, kebab-case or snake_case name, the first letter in upper case. Only ASCII letters are lowered."""
    spaced = F.regexp_replace(F.translate(name, "_-", "  "), r"(?<!^)(?<!\p{Lu})(\p{Lu})", " $1")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.translate(spaced, upper, lower)
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def flow_name(name: Column) -> Column:
    """camel_words of what follows the last dot."""
    return camel_words(F.element_at(F.split(name, r"\."), -1))


def is_test(path: Column) -> Column:
    """Any test mark anywhere in the path (so ``latest.ts`` too), or a declaration file."""
    marked = path.endswith(".d.ts")
    for mark in TEST_MARKS:
        marked = marked | path.contains(mark)
    return marked


def entry_kind(name: Column, path: Column) -> Column:
    """route, cli, handler or exported_entry, by the first rule that holds, on lower-cased name and path; ``main`` itself in lower case only."""
    n, p = F.lower(name), F.lower(path)
    return (
        F.when(n.contains("route") | p.contains("route") | p.contains("handler") | n.endswith("handler") | n.endswith("controller"), "route")
        .when((name == "main") | p.contains("/cli/") | p.contains("/bin/"), "cli")
        .when(n.contains("handler"), "handler")
        .otherwise("exported_entry")
    )


def encode_label(label: Column) -> Column:
    """Percent-encoded bytes but for letters, digits and ``-_.~``."""
    e = F.url_encode(label)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decode_label(encoded: Column) -> Column:
    """The inverse of encode_label, for every label."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def unix_seconds(time: Column) -> Column:
    """Whole seconds since 1970; null for null."""
    return F.unix_seconds(time.cast("timestamp"))


def seen_label(time: Column) -> Column:
    """The label under which a working directory is kept when it becomes the baseline."""
    return F.concat(F.lit("seen_"), unix_seconds(time).cast("string"))
