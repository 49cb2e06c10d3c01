"""Personal data by weak supervision, with DataFrame functions only.

Base patterns always count. Besides them there are looser candidates: failed base matches, phone numbers without ``+``, spelt-out or
defanged addresses, cards with other separators. All get votes from labelers, none of which knows the base rules: checksum, shape,
gazetteer, context before, context against, boundary. Expectation-maximisation on the table of vote patterns estimates each labeler's
reliability, its posteriors train a naive Bayes span classifier, and candidates that it is sure of become further spans.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesheaf.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
#: A further span needs this probability; EM rounds; characters of context looked at.
SURE, EM_ROUNDS, CONTEXT = 0.9, 40, 32
LABELERS = ["checksum", "shape", "gazetteer", "cue", "counter_cue", "boundary"]
#: What the classifier sees; the last four are not votes.
FEATURES = ["checksum", "shape", "cue", "counter_cue", "digits", "before", "after", "form"]
_OWN = FEATURES[4:]

# Stand-ins (private use characters) for a separator between two digits and for a dot between two label characters: with them
# chains are plain runs, which match without backtracking or recursion however long they are.
_SEP, _DOT, _TAKEN = "\ue000", "\ue001", "\ue002"
_L = "A-Za-z0-9-"

#: Gazetteers and cues.
TLDS = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "ch", "at", "it"]
DIAL_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91"]
CUES = {"email": "mail|contact|write to|correo|courriel", "ip": r"\bip\b|host|server|address|addr", "card": "card|visa|master|amex|credit|karte|carte|tarjeta", "phone": r"phone|call|\btel|mobile|fax|dial|telefon"}
COUNTER_CUES = r"(version|\bv|isbn|issn|\bid|sku|serial|order|build|release|section|chapter|\bno)[\s.:#-]{0,3}$"
# End of fixed values.


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order as array<struct<start,end>>, code points, end exclusive: lengths of what lies between and of matches add up."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(F.transform(found, F.length), F.transform(F.slice(between, 1, F.size(found)), F.length), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        end = begin + x["m"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(none)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _rule(kind: str, s: Column) -> Column:
    if kind == "ip":
        # Leading zeros may make parts long: what counts is at most three digits after them, at most 255.
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        d = _digits(s)
        return F.length(d).between(13, 19) & _luhn(F.substring(d, 1, 19))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _candidates(text: Column) -> Column:
    """array<struct<kind,start,end,s,base,loose,left,right>> of one text, base rules evaluated."""
    plain = F.translate(text, _SEP + _DOT, _TAKEN * 2)
    sep = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    dot = F.regexp_replace(plain, rf"(?<=[{_L}])\.(?=[{_L}])", _DOT)
    local = rf"A-Za-z0-9._%+{_DOT}-"
    dots = r"(?:\x20?[\[(](?:\.|dot)[\])]\x20?|\x20(?:\.|dot)\x20)"
    at = r"(?:\x20?[\[(](?:at|AT|@)[\])]\x20?|\x20(?:at|AT)\x20)"
    sources = [
        ("email", False, F.when(F.contains(text, F.lit("@")), dot).otherwise(""), rf"(?:(?<![{local}])|\G)[{local}]++@[{_L}]++{_DOT}[{_L}{_DOT}]++"),
        ("ip", False, text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
        ("card", False, sep, rf"[0-9{_SEP}]{{13,}}"),
        ("phone", False, F.when(F.contains(text, F.lit("+")), text).otherwise(""), r"\+[0-9][\x20().0-9-]+[0-9]"),
        ("phone", True, text, r"(?<![0-9+(.-])(?<![0-9)]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
        ("phone", True, text, r"(?<![0-9+])00[1-9][\x20().0-9-]{6,24}[0-9](?![0-9])"),
        ("card", True, text, r"(?<![0-9])[0-9]{4}([._/]|[\x20-]{2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
        ("ip", True, text, rf"(?<![0-9])[0-9]{{1,3}}(?:{dots}[0-9]{{1,3}}){{3}}(?![0-9])"),
        ("email", True, text, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{at}[A-Za-z0-9-]{{1,63}}(?:(?:{dots}|\.)[A-Za-z0-9-]{{1,63}}){{0,4}}(?:{dots}|\.)[A-Za-z]{{2,24}}(?![A-Za-z0-9-])"),
    ]

    def describe(kind: str, loose: bool):
        def one(m: Column) -> Column:
            s = F.substring(text, m["start"] + 1, m["end"] - m["start"])
            base = F.lit(False) if loose else _rule(kind, s)
            left = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), s.alias("s"), base.alias("base"), F.lit(loose).alias("loose"), left.alias("left"), F.substring(text, m["end"] + 1, F.lit(2)).alias("right"))

        return one

    parts = [F.transform(_matches(over, pattern), describe(kind, loose)) for kind, loose, over, pattern in sources]
    return F.concat(*parts)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _checksum(c: Column) -> Column:
    """Luhn for cards, parts for ip, number of digits for phones, a letter before the sign for email."""
    s, d, kind = c["s"], _digits(c["s"]), c["kind"]
    card, ip = F.length(d).between(13, 19) & _luhn(F.substring(d, 1, 19)), _rule("ip", F.regexp_replace(s, "[^0-9]+", "."))
    email = F.rlike(F.substring(s, 1, 64), F.lit("^[^@(\\[ ]*[A-Za-z]"))
    right = F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", F.length(d).between(9, 15)).otherwise(email)
    return _vote(right, ~right)


def _shape(c: Column) -> Column:
    """The usual grouping of digits or labels, whatever separates them; spans of over 64 characters have none."""
    forms = {
        "card": r"^([0-9]{13,16}|[0-9]{4}([^0-9]{0,2})[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|3[47][0-9]{2}[^0-9]?[0-9]{6}[^0-9]?[0-9]{5})$",
        "phone": r"^(\+|00)?\(?[0-9]{1,4}\)?([\x20.()-]{1,3}[0-9]{2,5}){1,5}$",
        "ip": r"^(0|[1-9][0-9]{0,2})([^0-9]+(0|[1-9][0-9]{0,2})){3}$",
        "email": r"[^A-Za-z0-9-][A-Za-z]{2,24}$",
    }
    hits = [F.when(c["kind"] == k, F.rlike(c["s"], F.lit(p))) for k, p in forms.items()]
    right = (F.length(c["s"]) <= 64) & F.coalesce(*hits)
    return _vote(right, ~right)


def _gazetteer(c: Column) -> Column:
    s, d = c["s"], _digits(c["s"])
    tld = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
    card = F.rlike(d, F.lit("^(3[47]|4|5[1-5]|6|2[2-7])"))
    local_ip = F.rlike(s, F.lit(r"^(0|127|22[4-9]|2[3-5][0-9])[^0-9]"))
    code = F.rlike(s, F.lit(r"^(\+|00)(" + "|".join(DIAL_CODES) + r")(?![0-9]{9,})"))
    area = F.rlike(s, F.lit(r"^\(?0?[2-9][0-9]{2}\)?"))
    kind = c["kind"]
    return F.when(kind == "email", _vote(tld.isin(TLDS), ~tld.isin(TLDS))).when(kind == "card", _vote(card, ~card)).when(kind == "ip", _vote(~local_ip, local_ip)).otherwise(_vote(code | area, F.lit(False)))


def _cue(c: Column) -> Column:
    hits = [F.when(c["kind"] == k, F.rlike(F.lower(c["left"]), F.lit(p))) for k, p in CUES.items()]
    return _vote(F.coalesce(*hits), F.lit(False))


def _edge(ch: Column) -> Column:
    """0 none, 1 white space, 2 punctuation, 3 letter or digit, 4 other."""
    return F.when(ch == "", 0).when(F.rlike(ch, F.lit(r"^\s")), 1).when(F.rlike(ch, F.lit(r"^[.,;:!?()\"'<>]")), 2).when(F.rlike(ch, F.lit(r"^[\p{L}\p{N}]")), 3).otherwise(4)


def _judged(c: Column) -> Column:
    """Adds the labelers' votes and the classifier's features to a candidate, dropping its texts."""
    n, before, after = F.length(_digits(c["s"])), _edge(F.substring(c["left"], -1, 1)), _edge(F.substring(c["right"], 1, 1))
    odd = (before >= 3) | (after >= 3)
    votes = [_checksum(c), _shape(c), _gazetteer(c), _cue(c), _vote(F.lit(False), F.rlike(F.lower(c["left"]), F.lit(COUNTER_CUES))), _vote(~odd, odd)]
    form = F.when(F.rlike(c["s"], F.lit(r"[()\[\]]")), 2).when(F.rlike(c["s"], F.lit(r"[\x20-]")), 1).otherwise(0)
    own = [F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4), before, after, form]
    named = [v.cast("int").alias(x) for v, x in zip([*votes, *own], [*LABELERS, *_OWN])]
    return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), *named)


def _normal(x: dict) -> dict:
    total = sum(x.values()) or 1.0
    return {k: v / total for k, v in x.items()}


def estimate(patterns: list[tuple]) -> dict:
    """EM over rows (kind, votes, count): the posterior of each (kind, votes), with labelers independent given the truth.

    Reliability is P(vote | truth) for each labeler, shared by all kinds; the prior is for each kind. Starts from the majority.
    """
    post = {(k, v): min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for k, v, _ in patterns}
    for _ in range(EM_ROUNDS):
        prior = defaultdict(lambda: [1.0, 1.0])
        table = [[defaultdict(lambda: 0.5) for _ in LABELERS] for _ in range(2)]
        for k, v, n in patterns:
            for y, p in ((1, post[k, v]), (0, 1 - post[k, v])):
                prior[k][y] += n * p
                for j, x in enumerate(v):
                    table[y][j][x] += n * p
        table = [[_normal({x: t[x] for x in (-1, 0, 1)}) for t in row] for row in table]
        for k, v, _ in patterns:
            s = math.log(prior[k][1] / prior[k][0])
            s += sum(math.log(table[1][j][x] / table[0][j][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))
    return post


def fit_classifier(rows: list[tuple], post: dict) -> tuple[dict, dict]:
    """Naive Bayes from rows (kind, votes, features, count) weighted by the posteriors: log-odds by kind and by (feature, value)."""
    total, by_kind, by_value = [1.0, 1.0], defaultdict(lambda: [0.5, 0.5]), defaultdict(lambda: [0.5, 0.5])
    for k, v, f, n in rows:
        for y, p in ((1, post[k, v]), (0, 1 - post[k, v])):
            total[y] += n * p
            by_kind[k][y] += n * p
            for j, x in enumerate(f):
                by_value[f"{k}:{FEATURES[j]}:{x}"][y] += n * p
    kinds = {k: math.log(c[1] / c[0]) for k, c in by_kind.items()}
    values = {}
    for key, c in by_value.items():
        own = by_kind[key.split(":")[0]]
        values[key] = math.log(c[1] / own[1]) - math.log(c[0] / own[0])
    return kinds, values


def _probability(c: Column, kinds: dict, values: dict) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (kinds | values).items() for x in kv]) if kinds else F.create_map(F.lit(""), F.lit(0.0))
    score = F.coalesce(F.element_at(table, c["kind"]), F.lit(-20.0))
    for f in FEATURES:
        score = score + F.coalesce(F.element_at(table, F.concat_ws(":", c["kind"], F.lit(f), c[f].cast("string"))), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-score))


def find_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (default: all) and ``pii``: array<struct<kind,start,end,base,p>> over the whole text, in order of kind and start.

    Offsets are code points, end exclusive. Null and empty texts give an empty array. Repeated rows stay; a column named ``pii``
    is replaced. Only counts of vote and feature patterns reach the driver; their number does not grow with the rows.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != "pii"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = df.select(*[F.col(f"`{c}`") for c in kept], F.transform(_candidates(body), _judged).alias("pii"))
    rows = written(held, "candidates")
    flat = rows.select(F.explode("pii").alias("c")).select("c.*")
    seen = [*LABELERS, *_OWN]
    counts = [(r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["count"]) for r in flat.groupBy("kind", *seen).count().orderBy("kind", *seen).collect()]
    patterns = defaultdict(int)
    for k, v, _, n in counts:
        patterns[k, v] += n
    kinds, values = fit_classifier(counts, estimate([(k, v, n) for (k, v), n in patterns.items()]))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    scored = lambda c: F.struct(F.element_at(place, c["kind"]).alias("i"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), F.when(c["base"], 1.0).otherwise(_probability(c, kinds, values)).alias("p"))
    base = F.filter("pii", lambda c: c["base"])
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    sure = F.filter(F.transform(F.filter("pii", lambda c: ~c["base"] & clear(c)), scored), lambda c: c["p"] >= SURE)
    final = F.transform(F.array_sort(F.concat(F.transform(base, scored), sure)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["p"].alias("p")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], final.alias("pii"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are covered by the one that starts first."""
    by_start = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(c["start"] - acc["at"], F.lit(0)))
        out = F.when(c["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
