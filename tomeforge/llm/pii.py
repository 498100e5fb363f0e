"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame functions only.

Generators with high recall propose spans, which may overlap: matches of a kind's strict
pattern, and of a loose one that strict rules miss. Strict matches are kept as they are. Loose
candidates get features of their format and of the words around them, boosted trees score
them, and those above the kind's threshold are kept. The trees are fitted on the driver, once
a process, on a sample of labelled spans that the module composes (``SAMPLE`` a kind, fixed
seed); they are applied as expressions of plain columns. A threshold lies half-way
below the lowest score that reaches ``PRECISION`` on held-out spans.

Every pattern is written without nested backtracking: repeats are possessive, so very long
runs cost time in proportion and no deep stack.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_parts, own, running, with_value

#: Base kinds, in the order they are listed; then the kinds of the method's own spans.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "hidden_email", "secret", "iban")
EMAIL_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # a local part starts where its run starts, or where the match before ended
    "email": rf"(?:(?<!{EMAIL_LOCAL})|\G){EMAIL_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # a run of digits and single separators, where it holds 13 digits; nothing shorter can be a card
    "card": r"(?<![0-9])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9]{1,3}[ -])(?<!\) )(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-][0-9]{2,6}){1,4}(?![0-9A-Za-z])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]?(?:at|AT|@)[\])]? ?[A-Za-z0-9-]{1,64}+ ?[\[(]?(?:dot|DOT|\.)[\])]? ?[A-Za-z]{2,12}(?![A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a kind to be searched for: a cheap plain search first.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "local_phone": "[0-9][ )./-]",
    "hidden_email": r"[@\[(]|(?i: dot )", "secret": "[A-Za-z0-9_+/=-]{16}", "iban": "[A-Z]{2}[0-9]{2}",
}
#: Words before a span that speak for it.
CUES = {
    "local_phone": "call|tel|phone|mobile|fax|whatsapp|contact",
    "hidden_email": "mail|contact|write|reach",
    "secret": "token|secret|key|password|passwd|pwd|auth|bearer|credential",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
BEFORE = 24
FEATURES = ("length", "digits", "upper", "lower", "separators", "kinds_of_chars", "cue", "changes", "vowels")
SAMPLE, PRECISION = 600, 0.98


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(kind: Column | str, span: Column, before: Column) -> dict[str, Column]:
    """Format and context features of a candidate; ``features_of`` is their plain twin."""
    cue = before.rlike(f"(?i)(?:{CUES[kind]})[^A-Za-z0-9]*(?:is|[:=])?[^A-Za-z0-9]*$").cast("double")
    kinds = sum((span.rlike(p).cast("double") for p in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]")), F.lit(0.0))
    return {
        "length": F.length(span).cast("double"),
        "digits": count(span, "[0-9]"),
        "upper": count(span, "[A-Z]"),
        "lower": count(span, "[a-z]"),
        "separators": count(span, "[^A-Za-z0-9]"),
        "kinds_of_chars": kinds,
        "cue": cue,
        "changes": count(span, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "vowels": count(span, "[aeiouAEIOU]"),
    }


def features_of(kind: str, span: str, before: str) -> list[float]:
    import re

    n = lambda p: float(len(re.findall(p, span)))
    cue = re.search(f"(?i)(?:{CUES[kind]})[^A-Za-z0-9]*(?:is|[:=])?[^A-Za-z0-9]*$", before)
    kinds = sum(bool(re.search(p, span)) for p in ("[0-9]", "[A-Z]", "[a-z]", "[^A-Za-z0-9]"))
    return [
        float(len(span)), n("[0-9]"), n("[A-Z]"), n("[a-z]"), n("[^A-Za-z0-9]"), float(kinds), float(bool(cue)),
        n("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), n("[aeiouAEIOU]"),
    ]


def labelled_spans(kind: str, n: int, seed: int) -> list[tuple[str, str, int]]:
    """n composed (span, text before it, label), half of them personal."""
    rng = np.random.default_rng([seed, KINDS.index(kind)])
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 10)))
    cues = CUES[kind].split("|")
    out = []
    for i in range(n):
        yes = i % 2
        cued = rng.random() < (0.7 if yes else 0.03)
        before = f"{word()} {rng.choice(cues)}{rng.choice([': ', ' = ', ' is ', ' ', '=', ' = \"'])}" if cued else f"{word()} {word()} "
        if kind == "local_phone":
            if yes:
                s = rng.choice([f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", f"{pick(dig, 3)}-{pick(dig, 3)}-{pick(dig, 4)}", f"{pick(dig, 3)}.{pick(dig, 3)}.{pick(dig, 4)}", f"0{pick(dig, 3)} {pick(dig, 6)}"])
            else:
                s = rng.choice([f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}", f"{pick(dig, 2)}/{pick(dig, 2)}/{pick(dig, 4)}", f"{pick(dig, 4)}-{pick(dig, 4)}", f"{pick(dig, 2)}.{pick(dig, 2)}", f"{pick(dig, 3)} {pick(dig, 3)}", f"{pick(dig, 2)} {pick(dig, 2)} {pick(dig, 2)}", ".".join(str(rng.integers(256)) for _ in range(4)), ".".join(str(rng.integers(256)) for _ in range(4)), " ".join(pick(dig, 4) for _ in range(4)), "-".join(pick(dig, 4) for _ in range(3))])
        elif kind == "hidden_email":
            if yes:
                s = rng.choice([f"{word()} [at] {word()} [dot] com", f"{word()}.{word()} (at) {word()} (dot) org", f"{word()} at {word()} dot net", f"{word()}(at){word()}.de", f"{word()} AT {word()} DOT com"])
            else:
                s = rng.choice([f"{word()} at {word()}.{word()[:4]}", f"{word()} at {word()} .{pick(low, 3)}", f"{word()} at {word()}. {word()[:6]}"])
                before = f"{word()} {word()} "
        elif kind == "secret":
            if yes:
                s = rng.choice([pick("0123456789abcdef", int(rng.integers(32, 65))), "AKIA" + pick(up + dig, 16), pick(low + up + dig, int(rng.integers(24, 48))), "sk_live_" + pick(low + up + dig, 24), "ghp_" + pick(low + up + dig, 36)])
            else:
                s = rng.choice([word() + word() + word() + word() + "aeioun", "-".join(word() for _ in range(5)), "_".join(word() for _ in range(5)), "=" * int(rng.integers(16, 60)), "-" * int(rng.integers(16, 60)), "/".join(word() for _ in range(4)) + "/index", pick(dig, 16), (word() + word() + word()).upper() + "NATIONALISATION", word().capitalize() + word().capitalize() + word().capitalize() + "Controller"])
        else:
            if yes:
                digits = pick(dig, int(rng.choice([14, 16, 18])))
                s = pick(up, 2) + pick(dig, 2) + digits
                s = " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.5 else s
            else:
                s = pick(up, 2) + pick(dig, 2) + pick(up + dig, 8) + pick(up, int(rng.choice([0, 4])))
        out.append((str(s), before[-BEFORE:], yes))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 2, rate: float = 0.3) -> list:
    """Gradient-boosted regression trees on the logistic loss; a tree is (feature, cut, left, right) or a leaf."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best = None
        for j in range(x.shape[1]) if depth else ():
            values = np.unique(x[rows, j])
            for cut in ((values[1:] + values[:-1]) / 2)[:: max(1, len(values) // 32)]:
                left = x[rows, j] < cut
                a, b = rows[left], rows[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, j, float(cut), a, b
        if best is None or best[0] <= g[rows].sum() ** 2 / (h[rows].sum() + 1) + 1e-6:
            return float(round(rate * g[rows].sum() / (h[rows].sum() + 1), 6))
        _, j, cut, a, b = best
        return j, cut, grow(a, g, h, depth - 1), grow(b, g, h, depth - 1)

    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
        score += np.array([leaf(trees[-1], row) for row in x])
    return trees


def leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        j, cut, left, right = tree
        tree = left if row[j] < cut else right
    return tree


@lru_cache(1)
def models() -> dict[str, tuple[list, float]]:
    """For each kind of its own: trees, and the threshold that holds-out spans calibrate."""
    out = {}
    for kind in KINDS[len(BASE) :]:
        spans = labelled_spans(kind, SAMPLE, 5)
        x, y = np.array([features_of(kind, s, b) for s, b, _ in spans]), np.array([c for *_, c in spans], float)
        fit = np.arange(len(y)) % 3 > 0
        trees = boost(x[fit], y[fit])
        score = np.array([sum(leaf(t, row) for t in trees) for row in x[~fit]])
        right = y[~fit]
        precise = [c for c in np.unique(score) if right[score >= c].mean() >= PRECISION]
        lowest = min(precise, default=np.inf)
        below = score[score < lowest].max(initial=-np.inf)
        out[kind] = trees, float(lowest if np.isinf(below) else (lowest + below) / 2)
    return out


def scored(kind: str, trees: list, row: Column) -> Column:
    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        j, cut, left, right = t
        return F.when(row[FEATURES[j]] < cut, tree(left)).otherwise(tree(right))

    return sum((tree(t) for t in trees), F.lit(0.0))


def matches(text: Column, kind: str) -> Column:
    """Every match of a kind's pattern, leftmost and not overlapping, as (start, end, span, before).

    The gaps between matches come from splitting at the same pattern, so their lengths and
    those of the matches add up to the places, in code points.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,end:int,span:string,before:string>>")

    def placed(parts: Column) -> Column:
        gap = lambda i: F.get(parts["gaps"], i)
        sizes = F.transform(parts["spans"], lambda x, i: F.length(gap(i)) + F.length(x))
        one = lambda ends: lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("span"), F.right(gap(i), F.lit(BEFORE)).alias("before"))
        return with_value(running(sizes), lambda ends: F.transform(parts["spans"], one(ends)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"), F.split(text, pattern, -1).alias("gaps"))
    found = with_value(parts, lambda p: F.when(F.size(p["spans"]) > 0, placed(p)).otherwise(none))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def strict(kind: str, x: Column) -> Column:
    """Whether a match of a base kind's pattern holds its kind's other rules."""
    digits = F.regexp_replace(x["span"], "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(x["span"], r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def likely(kind: str, x: Column) -> Column:
    """Whether the trees of a kind of the method's own keep a candidate."""
    trees, threshold = models()[kind]
    row = F.struct(*[c.alias(n) for n, c in features(kind, x["span"], x["before"]).items()])
    return with_value(row, lambda r: scored(kind, trees, r) >= threshold)


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: for each kind an array of (start, end), code points, end exclusive, by start.

    Base kinds hold every match of their pattern that passes their rules; the other kinds
    hold candidates that the trees keep, which may overlap spans of other kinds. A null text
    is empty. One pass without a shuffle; rows are judged each for itself, extra columns pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    keep = lambda kind: lambda x: strict(kind, x) if kind in BASE else likely(kind, x)
    kept = [plain(F.filter(matches(text, k), keep(k))).alias(k) for k in KINDS]
    # bound as one value, so that uses of its fields do not search again
    return docs.withColumn(name, with_value(F.struct(*kept), lambda found: found))


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    named = lambda kind: lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"])
    parts = [F.transform(found[k], named(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    named = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    parts = [F.transform(found[k], named(k)) for k in KINDS]

    def kept(spans: Column) -> Column:
        """Spans that begin where all before them have ended, each with that place, ``at``."""
        upto = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        each = lambda ends: F.transform(spans, lambda x, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.get(ends, F.size(ends) - 1).alias("last")))
        return with_value(upto, lambda ends: F.filter(each(ends), lambda x: x["start"] >= x["at"]))

    def replaced(part: Column) -> Column:
        """A part's spans with the text between them; places are looked up in that part of the text only."""
        first, last = F.get(part, 0), F.get(part, F.size(part) - 1)
        new = lambda body: F.transform(part, lambda x: F.concat(F.substring(body, x["at"] - first["at"] + 1, x["start"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.array_join(with_value(F.substring(text, first["at"] + 1, last["start"] - first["at"]), new), "")

    whole = lambda k: F.concat(F.array_join(F.transform(in_parts(k), replaced), ""), F.substring(text, F.get(k, 0)["last"] + 1, F.length(text)))
    replace = lambda spans: F.when(F.size(spans) > 0, with_value(kept(spans), whole)).otherwise(text)
    return with_value(F.sort_array(F.concat(*parts)), replace)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text column replaced by kinds in brackets. A null text stays null."""
    found = own("found")
    out = with_spans(docs, text_col, found)
    return out.withColumn(text_col, redacted(F.col(text_col), F.col(found))).select(*docs.columns)
