"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = r"[A-Za-z0-9_]+|[.,;:()\[\]{}]"
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"

# Query signals and words that carry no meaning.
CODE_SIGNALS = ("function", "class", "method", "def ", "import", "module", "api", "endpoint", "variable", "implement", "where is", "where defined", "signature", "call")
HOWTO_SIGNALS = ("how to", "how do i", "steps", "procedure", "playbook")
STOPWORDS = ("the", "a", "an", "is", "are", "to", "of", "and", "or")
NOISE = ("lol", "ok", "test", "asdf", "foo", "bar", "todo")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """Identifier runs split at case and digit changes, punctuation kept, lower-cased."""
    runs = F.regexp_extract_all(_col(text), F.lit(RUNS), F.lit(0))
    split = F.transform(runs, lambda r: F.struct(r.alias("run"), F.regexp_extract_all(r, F.lit(PARTS), F.lit(0)).alias("parts")))
    return F.transform(F.flatten(F.transform(split, lambda x: F.when(F.size(x["parts"]) > 0, x["parts"]).otherwise(F.array(x["run"])))), F.lower)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda's argument is not computed again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pairs(tokens) -> Column:
    """Neighbours, joined by ``_``."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))


def features(text) -> Column:
    """Tokens and the pairs of neighbours."""
    return let(tokenize(text), lambda t: F.concat(t, pairs(t)))


def infer_query_types(query) -> Column:
    """Types that a query hints at: code first, then how-to, else none."""
    q = F.lower(_col(query))

    def any_of(words):
        out = F.lit(False)
        for w in words:
            out = out | q.contains(w)
        return out

    return F.when(any_of(CODE_SIGNALS), F.array(F.lit("code_symbol"), F.lit("code_file"))).when(any_of(HOWTO_SIGNALS), F.array(F.lit("playbook"))).otherwise(F.array().cast("array<string>"))


def query_tokens(query) -> Column:
    """Distinct tokens of a query without stopwords."""
    return F.array_except(tokenize(query), F.array(*[F.lit(w) for w in STOPWORDS]))


def truncate(text, n: int) -> Column:
    """The first n code points."""
    return F.substring(_col(text), 1, n)


def field_tokens(text) -> Column:
    """Distinct lower-cased white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(_col(text))), r"\s+"), lambda w: w != ""))


def is_noise(text, extra=()) -> Column:
    """All tokens are noise words; empty content is not noise."""
    tokens = field_tokens(text)
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.array(*[F.lit(w) for w in (*NOISE, *extra)]))) == 0)


def playbook_content(name, steps) -> Column:
    numbered = F.transform(_col(steps), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.concat(_col(name), F.lit("\n"), F.array_join(numbered, "\n"))


def episode_content(agent, action, observation, outcome) -> Column:
    """``agent=... | action=... [| observation=...] [| outcome=...]``."""

    def part(label, c, always=False):
        c = _col(c)
        whole = F.concat(F.lit(f"{label}="), c)
        return F.concat(F.lit(f"{label}="), F.coalesce(c, F.lit(""))) if always else F.when(c != "", whole)

    return F.concat_ws(" | ", part("agent", agent, True), part("action", action, True), part("observation", observation), part("outcome", outcome))


def snippet_content(title, language, code) -> Column:
    return F.concat(_col(title), F.lit("\n```"), _col(language), F.lit("\n"), _col(code), F.lit("\n```"))


def split_lines(text) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(_col(text), "\n"), lambda s: F.trim(s) != "")


def split_tags(text) -> Column:
    return F.filter(F.transform(F.split(_col(text), ","), lambda s: F.trim(s)), lambda s: s != "")


def json_object(text) -> Column:
    """The outermost JSON object in a reply."""
    return F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)
