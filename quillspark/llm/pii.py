"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the matches of four patterns (valid or not) and of two loose ones. Labelers vote on each: the
shape (valid or not), a gazetteer (known top-level domains, address ranges, card issuers, country codes), the
words before it, and what touches it. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability for each kind of data, and a logistic span classifier is trained on its posteriors. Valid matches of
the four patterns always stay; other candidates that touch none of them are added where the classifier says so,
but one whose shape fails only where the words before it speak for it.

All matches of a text stay in its row, so nothing is shuffled but the counts of vote patterns, at most
4 * 3 ** 4 rows, which the driver reads.

Defined results: a null text counts as empty and has no spans; positions count code points, ends are exclusive;
rows are returned as often as given; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, pinned

KINDS = ("email", "ip", "card", "phone")
# The patterns, as given; a possessive run or a look behind changes no match, only the time it takes.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: A word that must stand in a text before a pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|info|io|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca)$",
    "ip": r"^(?!0*0\.)(?!0*127\.)(?!0*255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[4-9]|6)",
    "phone": r"^\+?(1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|^\(?[2-9]",
}
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write|correo|courriel|adresse|reach)",
    "ip": r"(?i)(\bip\b|address|host|server|adresse|login|client)",
    "card": r"(?i)(card|visa|master|amex|credit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(phone|call|tel|mobile|cell|fax|telefon|appel|llam)",
}
AGAINST = r"(?i)(version|order|serial|isbn|issn|ref\b|invoice|doi|sha|build|id[:=# ])"
BEFORE = 32


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    n = F.length(digits)
    # Luhn: from the right, every second digit doubled, its digits summed
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _found(df: DataFrame, out: str, pattern: str, needs: str | None) -> DataFrame:
    """df with `out`: the pattern's matches in text, as structs (start, stop, value, before, after)."""
    quoted = F.lit(pattern)
    tried = F.contains(F.col("text"), F.lit(needs)) if needs else F.lit(True)
    none = F.expr("cast(array() as array<string>)")
    df = pinned(df, __m=F.when(tried, F.regexp_extract_all("text", quoted, F.lit(0))).otherwise(none))
    df = pinned(df, __g=F.when(F.size("__m") > 0, F.split("text", pattern, -1)).otherwise(none))
    # each match begins where all gaps and matches before it end
    step = "(a, i) -> named_struct('at', a.at + length(__g[i]) + length(__m[i]), 'all', array_append(a.all, named_struct('start', a.at + length(__g[i]), 'stop', a.at + length(__g[i]) + length(__m[i]), 'value', __m[i], 'before', right(__g[i], {n}), 'after', left(__g[i + 1], 1))))"
    kind = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
    fold = f"if(size(__m) = 0, cast(array() as {kind}), aggregate(sequence(0, size(__m) - 1), named_struct('at', 0, 'all', cast(array() as {kind})), {step.format(n=BEFORE)}).all)"
    return pinned(df, **{out: F.expr(fold)}).drop("__m", "__g")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's identifier and its candidates: (kind, start, stop, base, shape, listed, told, apart)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = []
    for k, kind in enumerate(KINDS):
        for loose, pattern in ((False, PATTERNS[kind]), (True, LOOSE.get(kind))):
            if pattern is None:
                continue
            name = f"__{kind}{int(loose)}"
            needs = ("at" if kind == "email" else None) if loose else NEEDS.get(kind)
            df = _found(df, name, pattern, needs)

            def vote(c: Column) -> Column:  # used before the loop goes on
                value, before = c["value"], c["before"]
                valid = F.lit(False) if loose else _valid(kind, value)
                told = F.when(before.rlike(AGAINST), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
                touched = F.concat(F.right(before, F.lit(1)), c["after"]).rlike("[A-Za-z0-9]")
                return F.struct(
                    F.lit(k).alias("kind"),
                    c["start"].alias("start"),
                    c["stop"].alias("stop"),
                    valid.alias("base"),
                    (F.lit(0) if loose else F.when(valid, 1).otherwise(-1)).alias("shape"),
                    F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("listed"),
                    told.alias("told"),
                    F.when(touched, -1).otherwise(1).alias("apart"),
                )

            # a lone run of digits is no candidate for a card; it has to have a card's length
            held = F.filter(F.col(name), lambda c: F.length(F.regexp_replace(c["value"], "[^0-9]", "")).between(12, 19)) if kind == "card" else F.col(name)
            df = pinned(df, **{name + "v": F.transform(held, vote)}).drop(name)
            parts.append(name + "v")
    return df.select("doc_id", F.concat(*parts).alias("found"))


VOTES = ("shape", "listed", "told", "apart")


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Expectation-maximisation over vote patterns: the share of true spans, each labeler's chance of each vote
    (where the span is true, where it is not), and each pattern's posterior."""
    post = [1 / (1 + math.exp(-1.5 * sum(votes))) for votes, _ in counts]
    share, tables = 0.5, []
    for _ in range(rounds):
        true = sum(p * n for p, (_, n) in zip(post, counts))
        all_ = sum(n for _, n in counts)
        share = min(max((true + 1) / (all_ + 2), 0.001), 0.999)
        tables = []
        for j in range(len(VOTES)):
            own = {}
            for v in (-1, 0, 1):
                yes = sum(p * n for p, (votes, n) in zip(post, counts) if votes[j] == v)
                no = sum((1 - p) * n for p, (votes, n) in zip(post, counts) if votes[j] == v)
                # the prior counts say that a labeler is right more often than not
                own[v] = ((yes + 2 + 2 * (v == 1)) / (true + 8), (no + 2 + 2 * (v == -1)) / (all_ - true + 8))
            tables.append(own)
        post = []
        for votes, _ in counts:
            z = math.log(share / (1 - share)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
    return share, tables, post


def classifier(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 200) -> list[float]:
    """Logistic weights (bias last) over vote features, fitted on posteriors weighted by count."""
    feats = [[float(v == w) for v in votes for w in (-1, 1)] + [1.0] for votes, _, _ in rows]
    w, total = [0.0] * (2 * len(VOTES) + 1), sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        grad = [0.01 * x for x in w]
        for f, (_, n, p) in zip(feats, rows):
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f))))
            for i, x in enumerate(f):
                grad[i] += n / total * (q - p) * x
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, base and spans (arrays of kind, start, stop in order)."""
    held = materialize(candidates(docs, id_col, text_col), "pii-candidates")
    seen = held.select(F.explode("found").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in VOTES]).count().collect()
    score: Column = F.lit(-1.0)
    weights = {}
    for k in range(len(KINDS)):
        own = sorted((tuple(r[v] for v in VOTES), r["count"]) for r in seen if r["kind"] == k)
        if own:
            _, _, post = reliabilities(own)
            weights[k] = classifier([(votes, n, p) for (votes, n), p in zip(own, post)])

    def likely(c: Column) -> Column:
        out = score
        for k, w in weights.items():
            z = F.lit(w[-1])
            for j, v in enumerate(VOTES):
                z = z + F.when(c[v] == -1, w[2 * j]).when(c[v] == 1, w[2 * j + 1]).otherwise(0.0)
            out = F.when(c["kind"] == k, z).otherwise(out)
        # a match whose shape fails needs words before it that speak for it
        return (out >= 0.0) & ((c["shape"] >= 0) | (c["told"] == 1))

    order = "array_sort(transform({0}, c -> named_struct('start', c.start, 'kind', c.kind, 'stop', c.stop)))"
    out = pinned(held, base=F.filter("found", lambda c: c["base"]), extra=F.filter("found", lambda c: ~c["base"] & likely(c)))
    out = pinned(out, added=F.expr("filter(extra, e -> not exists(base, b -> b.start < e.stop and e.start < b.stop))"))
    return out.select("doc_id", F.expr(order.format("base")).alias("base"), F.expr(order.format("array_distinct(concat(base, added))")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, c -> concat(array({names})[c.kind], ':', c.start, ':', c.stop)), ',')")
