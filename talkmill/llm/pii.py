"""Personal data by weak supervision, in column expressions only.

Fixed rules find e-mail addresses, IP addresses, card and phone numbers; these
spans always stay. Looser patterns give further candidates, and three labelers
vote on each: a strict form or check digits, a gazetteer (known prefixes, domain
ends, words) and the words just before it. Expectation-maximisation over the
counts of all vote patterns estimates how reliable each labeler is, and gives
every pattern a probability. With these as soft labels a logistic classifier is
trained on the votes and two more features, and candidates it accepts are added
unless they touch a span that is there.

The model is learnt from counts of (kind, votes, features) over all documents:
at most ``len(KINDS) * 2**5`` rows reach the driver. Texts are read where they
are stored, once to count and once to mark, and are not shuffled.

Positions count code points, ends are exclusive. Patterns are possessive and
begin only where a run of their characters begins, so long runs take linear time; positions of many matches in one text
are summed in chunks.

Defined results: a null text counts as empty and has no span; equal rows each give
a row; an empty table gives an empty result, and kinds without candidates no model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import CHUNK, let, running

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn")
VOTES = ("form", "gazetteer", "context")
FEATURES = (*VOTES, "long", "separated")
ROUNDS = 60

# The base patterns. A match inside a run of the same characters can only begin where the run or the search begins.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # with fewer than fourteen digits a match would be dropped
    "card": r"(?<![0-9])[0-9](?=(?:[ -]?[0-9]){13})(?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must contain for a pattern to be tried.
_TRIED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}

_SECRET_WORD = r"(?:password|passwd|token|secret|key)"
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++"
    r"(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])[0-9](?=(?:[ -]?[0-9]){12})(?:[ -]?[0-9])++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?<=" + _SECRET_WORD + r"[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[A-Za-z0-9_+/.-]{8,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_LOOSE_TRIED = {
    "email": "[\\[(]at[\\])]",
    "card": "[0-9][ -]?[0-9]",
    "phone": "[0-9][ .-][0-9]{4}",
    "secret": r"(?i)" + _SECRET_WORD + r"[ ]{0,2}[=:]",
    "ssn": "[0-9]-[0-9]{2}-[0-9]",
}
_GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\(?[2-9][0-9]{2}[^0-9]{1,2}[2-9]",
    "secret": r"(?=.*[0-9]).*[A-Za-z]",
    "ssn": r"^(?!000|666|9)",
}
_CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel)",
    "card": r"(?i)(?:card|visa|credit|pay|carte|tarjeta|karte)",
    "phone": r"(?i)(?:call|phone|tel|fax|mobile|cell|anruf|llam)",
    "secret": r"(?i)" + _SECRET_WORD,
    "ssn": r"(?i)(?:ssn|social|security)",
}
_BEFORE = 32
# Behind the end of any text.
_FAR = 2**31 - 1


def _matches(text: Column, pattern: str, tried: str) -> Column:
    """The matches of a pattern: array of (start, end, match, before)."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def found(parts: Column, hits: Column) -> Column:
        sizes = F.zip_with(parts, hits, lambda part, hit: F.length(part) + F.length(hit))
        places = F.arrays_zip(running(sizes, lambda a, b: a + b, 0).alias("at"), parts.alias("part"), hits.alias("hit"))
        return F.transform(
            places,
            lambda x: F.struct(
                (x["at"] + F.length(x["part"])).alias("start"),
                (x["at"] + F.length(x["part"]) + F.length(x["hit"])).alias("end"),
                x["hit"].alias("match"),
                F.right(x["part"], F.lit(_BEFORE)).alias("before"),
            ),
        )

    def placed(hits: Column) -> Column:
        # the part behind the last match is not needed
        parts = F.slice(F.split(text, pattern), F.lit(1), F.size(hits))
        return F.when(F.size(hits) == 0, none).otherwise(let(parts, lambda each: found(each, hits)))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(tried), let(hits, placed)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        doubled = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda total, x: total + x) % 10 == 0


def _card_right(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(14, 19) & _luhn(d))


def _ip_right(match: Column) -> Column:
    parts = F.transform(F.split(match, "\\."), lambda part: F.regexp_replace(part, "^0+", ""))
    return F.forall(parts, lambda part: (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255))


def _base(text: Column) -> Column:
    """The base spans: array of (start, place of the kind, kind, end), not sorted."""
    right = {
        "email": lambda match: F.lit(True),
        "ip": _ip_right,
        "card": _card_right,
        "phone": lambda match: F.length(_digits(match)).between(10, 15),
    }
    arrays = []
    for place, kind in enumerate(BASE_KINDS):
        passes, span = _on_match(right[kind]), _span_of(kind, place)
        arrays.append(F.transform(F.filter(_matches(text, _BASE[kind], _TRIED[kind]), passes), span))
    return F.concat(*arrays)


def _on_match(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: rule(m["match"])


def _span_of(kind: str, place: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end")
    )


def _candidates(text: Column) -> Column:
    """Candidates with their votes and features: array of (start, place, kind, end, form, ..., separated)."""
    form = {
        "email": lambda match: match.rlike(r"(?:\(at\).*\(dot\)|\[at\].*\[dot\])"),
        "card": _card_right,
        "phone": lambda match: match.rlike(r"^(?:\([0-9]{3}\) ?[0-9]{3}-|[0-9]{3}([ .-])[0-9]{3}\1)"),
        "secret": lambda match: F.length(match) >= 16,
        "ssn": lambda match: match.rlike("^[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    }

    def judged(kind: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"),
            m["end"].alias("end"),
            form[kind](m["match"]).alias("form"),
            m["match"].rlike(_GAZETTEER[kind]).alias("gazetteer"),
            m["before"].rlike(_CONTEXT[kind]).alias("context"),
            (F.length(m["match"]) >= 16).alias("long"),
            m["match"].rlike("[ ()-]").alias("separated"),
        )

    return F.concat(
        *[F.transform(_matches(text, pattern, _LOOSE_TRIED[kind]), judged(kind)) for kind, pattern in _LOOSE.items()]
    )


@dataclass
class SpanModel:
    """Weights of the span classifier per kind, and the estimated reliabilities of the labelers."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    reliabilities: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)

    def accepts(self, candidate: Column) -> Column:
        """Whether the classifier gives a candidate at least one half."""
        total = F.lit(-1.0)
        for kind, (bias, *weights) in self.weights.items():
            value = F.lit(bias)
            for name, weight in zip(FEATURES, weights):
                value = value + F.when(candidate[name], weight).otherwise(0.0)
            total = F.when(candidate["kind"] == kind, value).otherwise(total)
        return total >= 0


def expectation_maximisation(counts: dict[tuple[bool, ...], int]) -> tuple[dict[tuple[bool, ...], float], list[tuple]]:
    """The probability of each vote pattern, and each labeler's share of votes on true and on false candidates.

    Votes are taken as independent given the truth. Labelers begin as mostly
    right, which decides which of the two classes is the true one.
    """
    total = sum(counts.values())
    share, true, false = 0.5, [0.8] * len(VOTES), [0.2] * len(VOTES)
    chance: dict[tuple[bool, ...], float] = {}
    for _ in range(ROUNDS):
        for votes in counts:
            yes, no = share, 1 - share
            for vote, t, f in zip(votes, true, false):
                yes *= t if vote else 1 - t
                no *= f if vote else 1 - f
            chance[votes] = yes / (yes + no)
        mass = sum(n * chance[votes] for votes, n in counts.items())
        # one imagined document on each side keeps shares off 0 and 1
        share = (mass + 1) / (total + 2)
        for k in range(len(VOTES)):
            hits = sum(n * chance[votes] for votes, n in counts.items() if votes[k])
            all_hits = sum(n for votes, n in counts.items() if votes[k])
            true[k] = (hits + 0.8) / (mass + 1)
            false[k] = (all_hits - hits + 0.2) / (total - mass + 1)
    return chance, list(zip(true, false))


def _logistic(rows: list[tuple[tuple[bool, ...], float, int]]) -> list[float]:
    """Bias and weights by gradient steps on weighted soft labels, with a small ridge."""
    weights = [0.0] * (len(FEATURES) + 1)
    total = sum(n for _, _, n in rows)
    for _ in range(400):
        slope = [-0.001 * w for w in weights]
        for x, target, n in rows:
            inputs = (1.0, *map(float, x))
            error = target - 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, inputs))))
            for k, v in enumerate(inputs):
                slope[k] += error * v * n / total
        weights = [w + s for w, s in zip(weights, slope)]
    return weights


def learn(docs: DataFrame) -> SpanModel:
    """Estimate the labelers and train the span classifier on all documents (text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.explode(_candidates(text)).alias("c")).select("c.kind", *[f"c.{name}" for name in FEATURES])
    # at most one row for each kind and pattern
    counted = each.groupBy("kind", *FEATURES).count().collect()
    model = SpanModel()
    for kind in KINDS:
        rows = sorted((tuple(row[1:-1]), row[-1]) for row in counted if row[0] == kind)
        if not rows:
            continue
        votes: dict[tuple[bool, ...], int] = {}
        for pattern, n in rows:
            votes[pattern[: len(VOTES)]] = votes.get(pattern[: len(VOTES)], 0) + n
        chance, reliable = expectation_maximisation(votes)
        model.reliabilities[kind] = dict(zip(VOTES, reliable))
        model.weights[kind] = _logistic([(pattern, chance[pattern[: len(VOTES)]], n) for pattern, n in rows])
    return model


def annotate(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with two more columns: _base and _spans, arrays of (start, place, kind, end) sorted by start and kind.

    Columns named _base, _spans or _candidates are replaced; ``redact`` keeps them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"_base": F.array_sort(_base(text)), "_candidates": _candidates(text)})
    span = lambda s, added: F.struct(
        s["start"].alias("start"), F.lit(added).alias("added"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")
    )

    def kept(spans: Column) -> Column:
        """Base spans, and candidates that none before reaches and none behind begins within."""
        reach = running(F.transform(spans, lambda s: F.when(s["added"], 0).otherwise(s["end"])), F.greatest, 0)
        begins = F.transform(spans, lambda s: F.when(s["added"], _FAR).otherwise(s["start"]))
        following = F.reverse(running(F.reverse(begins), F.least, _FAR))
        placed = F.arrays_zip(spans.alias("span"), reach.alias("reach"), following.alias("following"))
        free = lambda x: ~x["span"]["added"] | (
            (x["reach"] <= x["span"]["start"]) & (x["following"] >= x["span"]["end"])
        )
        return F.transform(F.filter(placed, free), lambda x: x["span"].dropFields("added"))

    accepted = F.filter("_candidates", model.accepts)
    base = F.transform("_base", lambda s: span(s, False))
    both = lambda added: F.array_sort(F.concat(base, F.transform(added, lambda s: span(s, True))))
    spans = let(accepted, lambda added: F.when(F.size(added) == 0, F.col("_base")).otherwise(let(both(added), kept)))
    return found.withColumn("_spans", spans).drop("_candidates")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans by the first's kind.

    Columns of any name stay: the documents travel as one struct beside what is computed.
    """
    marked = annotate(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), learn(docs))

    text, spans = F.col("text"), F.col("_spans")
    # how far the spans before each one reach
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
    placed = F.arrays_zip(
        F.transform(spans, lambda s: s["start"]).alias("start"), F.transform(spans, lambda s: s["end"]).alias("end"),
        F.transform(spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("label"), reach.alias("at"),
    )

    def pieces(chunk: Column) -> Column:
        """A chunk's spans with the text before each; the chunk's stretch is cut out once, as cutting counts from the front."""
        begin = chunk[0]["at"]
        stretch = F.substring(text, begin + 1, F.element_at(chunk, -1)["end"] - begin)
        piece = lambda cut: lambda x: F.when(
            x["start"] >= x["at"], F.concat(F.substring(cut, x["at"] - begin + 1, x["start"] - x["at"]), x["label"])
        ).otherwise("")
        return let(stretch, lambda cut: F.array_join(F.transform(chunk, piece(cut)), ""))

    def marked_text(all_spans: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / CHUNK).cast("int"))
        parts = F.transform(places, lambda k: let(F.slice(all_spans, k * CHUNK + 1, F.lit(CHUNK)), pieces))
        last = F.element_at(all_spans, -1)
        return F.concat(F.array_join(parts, ""), F.substr(text, F.greatest(last["at"], last["end"]) + 1))

    text = F.when(F.size(spans) == 0, text).otherwise(let(placed, marked_text))
    rest = [F.col(f"row.`{name}`").alias(name) if name != "text" else text.alias(name) for name in docs.columns]
    return marked.select(*rest)
