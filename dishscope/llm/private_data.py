"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall patterns propose spans of four kinds, which may overlap.  Each span
has format features (digits, separators, check digit, octets, domain) and context
features (the characters beside it, a telling word before it).  Boosted trees learn
from planted truth: into stretches of a bounded sample of documents, generated
personal data and look-alikes (version numbers, order numbers, dates, parts,
places) are written, and a candidate's label is whether it is exactly an item that was
planted as personal data.  No feature and no check enters a label.  The candidates are
counted by their features in one grouped aggregation, whose rows are bounded by the
product of the features' ranges, and the trees are fitted on the driver from these
counts.  On the fifth of the documents that no tree has seen, a threshold is chosen for
each kind, the lowest whose selections are right at least ``PRECISION`` of the time.  Spans
of the fixed base patterns always stay; the trees add those that do not overlap a base
span of their kind.

Null texts count as empty: no spans.  Rows are handled one by one.  Without documents
to plant in, nothing is added to the base spans.  The time of a text grows with its
length, and with its spans times its length where it is redacted.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, pick, remainder

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS, DEPTH, RATE = 24, 3, 0.4
#: Documents, about, whose stretches are planted with items, and items a document (a multiple of 8).
SAMPLE, PLANTS = 4000, 8

# Possessive and anchored forms of the base patterns: the same leftmost matches in
# one pass, whatever the length of a run.  A card is a whole run of 16 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the base patterns leave out: words for signs, digits within longer runs, numbers without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])",
}
TELLING = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|mailto)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|account|payment)",
    "phone": r"(?i)(?:phone|\btel\b|call|mobile|cell|fax|whatsapp|sms|number)",
}
#: Features of a candidate, and the number of values of each.
FEATURES = {"kind": 4, "wide": 2, "digits": 21, "marks": 6, "luhn": 2, "octets": 2, "domain": 2, "lead": 10, "before": 4, "after": 4, "told": 2, "length": 11}


_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def hits(text: Column, pattern: str, needs: Column) -> Column:
    """Array of (start, end, value, before, after) of the leftmost matches; code points, end exclusive.

    ``before`` holds up to 24 characters in front of a match and ``after`` the one
    behind it, from the gaps between matches, so no text is gone through twice.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def described(both: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            gap, last = F.get(both["gaps"], i), F.coalesce(F.get(both["found"], i - 1), F.lit(""))
            before = F.when(i == 0, gap).otherwise(F.concat(last, gap))
            return F.struct(F.length(gap).alias("gap"), v.alias("value"), F.right(before, F.lit(24)).alias("before"), F.left(F.coalesce(F.get(both["gaps"], i + 1), F.lit("")), F.lit(1)).alias("after"))

        return F.transform(both["found"], one)

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        end = start + F.length(p["value"])
        span = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["before"].alias("before"), p["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))
    both = F.struct(gaps.alias("gaps"), found.alias("found"))
    spans = F.get(F.transform(F.array(both), lambda b: F.aggregate(described(b), zero, add)["out"]), 0)
    return F.when(needs, spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def luhn_sum(v: Column) -> Column:
    """The check sum of the digits of a text: every second from the end counts double."""

    def of(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            x = F.ascii(F.substring(d, i, F.lit(1))) - 48
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return a + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add)

    return _let(F.reverse(_digits(v)), of)


def luhn(v: Column) -> Column:
    return v.rlike("[0-9]") & (luhn_sum(v) % 10 == 0)


def octets(v: Column) -> Column:
    def small(p: Column) -> Column:
        core = F.regexp_replace(p, "^0+", "")
        return (F.length(core) <= 2) | ((F.length(core) == 3) & (core <= "255"))

    parts = F.filter(F.split(v, r"[^0-9]+"), lambda p: F.length(p) > 0)
    return (F.size(parts) == 4) & F.forall(parts, small)


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (start, end, value) by kind: what the base patterns find and their checks keep."""
    digit = text.rlike(r"[0-9][\x20-]?[0-9]")
    found = {
        "email": hits(text, BASE["email"], F.contains(text, F.lit("@"))),
        "ip": hits(text, BASE["ip"], text.rlike(r"[0-9]\.[0-9]")),
        "card": hits(text, BASE["card"], digit),
        "phone": hits(text, BASE["phone"], text.rlike(r"\+[0-9]")),
    }
    found["ip"] = F.filter(found["ip"], lambda h: octets(h["value"]))
    found["card"] = F.filter(found["card"], lambda h: luhn(h["value"]))
    found["phone"] = F.filter(found["phone"], lambda h: F.length(_digits(h["value"])).between(8, 15))
    return found


def _side(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^[\p{L}]"), 1).otherwise(3)


def _described(spans: Column, kind: str, wide: bool) -> Column:
    """Spans with their features."""

    def one(h: Column) -> Column:
        v, digits = h["value"], _digits(h["value"])
        lead = F.when(digits == "", 0).otherwise(F.ascii(digits) - 48)
        features = {
            "kind": F.lit(KINDS.index(kind)),
            "wide": F.lit(int(wide)),
            "digits": F.least(F.length(digits), F.lit(20)),
            "marks": F.least(F.length(F.regexp_replace(v, r"[A-Za-z0-9\s]", "")), F.lit(5)),
            "luhn": luhn(v).cast("int") if kind == "card" else F.lit(0),
            "octets": octets(v).cast("int") if kind == "ip" else F.lit(0),
            "domain": v.rlike(r"[A-Za-z]{2,6}$").cast("int") if kind == "email" else F.lit(0),
            "lead": lead,
            "before": _side(F.right(h["before"], F.lit(1))),
            "after": _side(h["after"]),
            "told": h["before"].rlike(TELLING[kind]).cast("int"),
            "length": F.least(F.floor(F.length(v) / 4), F.lit(10)).cast("int"),
        }
        sound = {"email": F.lit(True), "ip": octets(v), "card": luhn(v), "phone": F.length(digits).between(8, 15)}[kind]
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), (F.lit(not wide) & sound).alias("base"), *[features[n].cast("int").alias(n) for n in FEATURES])

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """All proposed spans with their features: base patterns before their checks, and the wide ones."""
    needs = {"email": text.rlike(r"(?:\(at\)|\[at\]|\{at\}|\x20at\x20)"), "ip": text.rlike(r"[0-9]\x20?[.\[(]"), "card": text.rlike("[0-9]{4}"), "phone": text.rlike(r"[0-9][\x20./-][0-9]{3}")}
    wide = [_described(hits(text, WIDE[k], needs[k]), k, True) for k in KINDS]
    again = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[_described(hits(text, BASE[k], again[k]), k, False) for k in KINDS], *wide)


#: What stands before items in planted stretches: words that tell of personal data, and words that do not.
LEADS = {
    "email": ("email: ", "e-mail ", "contact me, ", "write to ", "reach us: ", "mailto:"),
    "ip": ("ip ", "address ", "from host ", "server ", "login from ", "client "),
    "card": ("card ", "visa ", "credit card no. ", "paid by mastercard ", "account ", "payment: "),
    "phone": ("phone: ", "tel. ", "call ", "mobile ", "fax ", "my number is "),
}
PLAIN_LEADS = ("and ", "the ", "then ", "was ", "of ", "(", "", "see ")
OTHER_LEADS = ("version ", "v", "section ", "order ", "serial ", "isbn ", "part no. ", "build ", "item ", "id", "invoice ", "on ")


def _dice(*parts) -> Column:
    """A number that follows from the document, the item and what it is drawn for."""
    return F.xxhash64(F.col("doc_id"), F.col("item"), *[F.lit(p) for p in parts])


def _one_of(choices, *parts) -> Column:
    options = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.element_at(F.array(*options), (F.pmod(_dice(*parts), F.lit(len(options))) + 1).cast("int"))


def _number(least: int, most: int, *parts) -> Column:
    return (F.pmod(_dice(*parts), F.lit(most - least + 1)) + least).cast("string")


def _some_digits(n: int, *parts) -> Column:
    return F.lpad(F.pmod(_dice(*parts), F.lit(10**n)).cast("string"), n, "0")


def _name(*parts) -> Column:
    """Three to ten letters."""
    letters = F.translate(F.md5(_dice(*parts).cast("string")), "0123456789", "rstlnmiyou")
    return F.substring(letters, F.lit(1), (F.pmod(_dice(*parts, "size"), F.lit(8)) + 3).cast("int"))


def _grouped(digits: Column, mark: str) -> Column:
    return F.concat_ws(mark, *[F.substring(digits, i, 4) for i in (1, 5, 9, 13)])


def drawn(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, item) with the parts that items are put together from."""
    cols = {"user": _name("user"), "host": _name("host"), "next": _name("next"), "top": _one_of(("com", "org", "net", "de", "fr", "info"), "top")}
    cols |= {f"octet{i}": _number(1, 254, "octet", i) for i in range(4)} | {f"low{i}": _number(0, 20, "low", i) for i in range(5)}
    cols |= {"area": _some_digits(3, "area"), "mid": _some_digits(3, "mid"), "last": _some_digits(4, "last")}
    cols |= {"body": F.concat(_one_of("3456", "lead"), _some_digits(14, "body")), "order": _some_digits(16, "order")}
    rows = rows.withColumns(cols)
    check = (10 - luhn_sum(F.concat("body", F.lit("0"))) % 10) % 10
    return rows.withColumn("number", F.concat("body", check.cast("string")))


def planted_items() -> dict[str, tuple[Column, Column]]:
    """kind -> (personal data, look-alike), from the columns of ``drawn``."""
    user, host, top, area, mid, last = (F.col(c) for c in ("user", "host", "top", "area", "mid", "last"))
    signs = (("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" {at} ", " {dot} "), ("(at)", " (dot) "))
    sure = [F.concat(user, F.lit(at), host, F.lit(dot), top) for at, dot in signs]
    place = [F.concat(user, F.lit(" at "), host, F.lit("."), F.col("next")), F.concat(user, F.lit(" at "), host, F.lit(" dot matrix")), F.concat(user, F.lit("@"), host)]
    octet, low = [F.col(f"octet{i}") for i in range(4)], [F.col(f"low{i}") for i in range(5)]
    address = [F.concat_ws(dot, *octet) for dot in (".", "[.]", "(.)", ".")]
    versions = [F.concat_ws(".", *low[:4]), F.concat_ws(".", *low), F.concat_ws(".", _number(256, 999, "big"), *octet[:3]), F.concat_ws(" . ", *low[:4])]
    cards = [_grouped(F.col("number"), mark) for mark in (" ", "-", "", ".")]
    orders = [*[_grouped(F.col("order"), mark) for mark in (" ", "-", "", ".")], F.concat("order", mid)]
    full = F.concat(F.lit("+"), _number(1, 99, "land"), F.lit(" ("), area, F.lit(") "), mid, F.lit("-"), last)
    phones = [full, F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), last), *[F.concat_ws(mark, area, mid, last) for mark in ("-", " ", ".")]]
    day = F.concat_ws("-", _number(10, 31, "day"), _number(100, 366, "of"), _number(1900, 2030, "year"))
    sums = F.concat_ws(" ", _number(10, 999, "x"), _number(100, 999, "y"), _number(100, 999, "z"))
    dates = [day, sums, F.concat_ws(".", area, mid, last), F.concat(F.lit("+"), _number(1, 9, "p"), F.lit("-"), _number(1, 9, "q"))]
    forms = {"email": (sure, place), "ip": (address, versions), "card": (cards, orders), "phone": (phones, dates)}
    return {k: (_one_of(a, "form"), _one_of(b, "form")) for k, (a, b) in forms.items()}


def planted(docs: DataFrame, sample: int = SAMPLE, plants: int = PLANTS) -> DataFrame:
    """doc_id, text, kind, start, end, real: stretches of documents with one item each, written at [start, end)."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    share = min(1.0, sample / max(rows.count(), 1))
    some = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("planted")), F.lit(1 << 30)) < max(1, int(share * (1 << 30))))
    some = some.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(plants - 1))).alias("item"))
    at = (F.pmod(_dice("place"), F.greatest(F.length("text") - 80, F.lit(1))) + 1).cast("int")
    some = drawn(some.select("doc_id", "item", F.substring(F.col("text"), at, F.lit(50)).alias("left"), F.substring(F.col("text"), at + 50, F.lit(30)).alias("right")))
    kind, real = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("item") % 4 + 1), F.floor(F.col("item") / 4) % 2 == 0
    items = planted_items()
    value = F.lit("")
    lead = _one_of(PLAIN_LEADS, "lead word")
    told = F.lit("")
    for k in KINDS:
        value = F.when(kind == k, F.when(real, items[k][0]).otherwise(items[k][1])).otherwise(value)
        told = F.when(kind == k, _one_of(LEADS[k], "telling")).otherwise(told)
    # personal data is told of more often than not, look-alikes sometimes are
    dice = F.pmod(_dice("told"), F.lit(10))
    lead = F.when(real & (dice < 6), told).when(~real & (dice < 1), told).when(~real & (dice < 6), _one_of(OTHER_LEADS, "other")).otherwise(lead)
    behind = _one_of((" ", ". ", ", ", ") ", "\n", "; "), "behind")
    front = F.concat("left", F.lit(" "), lead)
    spec = some.select("doc_id", kind.alias("kind"), real.alias("real"), front.alias("front"), value.alias("value"), F.concat(behind, "right").alias("back"))
    start = F.length("front")
    return spec.select("doc_id", F.concat("front", "value", "back").alias("text"), "kind", start.alias("start"), (start + F.length("value")).alias("end"), "real")


def labelled(stretches: DataFrame) -> DataFrame:
    """doc_id, c (a candidate), real: the candidates that touch a planted item; real where they are exactly one of personal data."""
    each = stretches.withColumn("candidates", candidates(F.col("text"))).select("doc_id", "kind", "start", "end", "real", F.explode("candidates").alias("c"))
    each = each.filter((F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end")))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    whole = (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end")) & (F.col("c.kind") == number)
    return each.select("doc_id", "c", (whole & F.col("real")).alias("real"))


class Boosted:
    """Trees as nested tuples (feature, threshold, left, right) with leaf values, and a threshold by kind."""

    def __init__(self, start: float, trees: list, thresholds: dict[int, float]):
        self.start, self.trees, self.thresholds = start, trees, thresholds

    def score(self, c: Column) -> Column:
        def walk(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(c[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        out = F.lit(float(self.start))
        for t in self.trees:
            out = out + walk(t)
        return out

    def selects(self, c: Column) -> Column:
        limit = F.lit(math.inf)
        for kind, value in self.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(float(value))).otherwise(limit)
        return self.score(c) >= limit


def boost(cells: list[tuple[dict[str, int], int, float, float]]) -> Boosted:
    """Fit on counted candidates: (features, held out or not, number, number labelled 1)."""
    names = list(FEATURES)
    x = np.array([[f[n] for n in names] for f, _, _, _ in cells], np.int64).reshape(-1, len(names))
    held = np.array([c[1] for c in cells], bool)
    n, y = np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
    own, total, positive = np.nonzero(~held)[0], n[~held].sum(), y[~held].sum()
    start = math.log((positive + 1) / (total - positive + 1))
    raw, trees = np.full(len(cells), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        sg, sh = g[rows].sum(), h[rows].sum()
        best, cut = 1e-6, None
        for k, name in enumerate(names if depth and len(rows) > 1 else ()):
            lg = np.cumsum(np.bincount(x[rows, k], g[rows], FEATURES[name]))[:-1]
            lh = np.cumsum(np.bincount(x[rows, k], h[rows], FEATURES[name]))[:-1]
            gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
            if len(gain) and gain.max() > best:
                best, cut = gain.max(), (k, int(gain.argmax()))
        if cut is None:
            return float(RATE * sg / (sh + 1.0))
        left = x[rows, cut[0]] <= cut[1]
        return (names[cut[0]], cut[1], grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    def values(t, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(t, tuple):
            out[rows] += t
            return
        left = x[rows, names.index(t[0])] <= t[1]
        values(t[2], rows[left], out)
        values(t[3], rows[~left], out)

    for _ in range(ROUNDS if 0 < positive < total else 0):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        tree = grow(own, y - n * p, n * p * (1 - p), DEPTH)
        trees.append(tree)
        values(tree, np.arange(len(cells)), raw)

    thresholds = {}
    for kind in range(len(KINDS)):
        rows = np.nonzero((x[:, 0] == kind) & held)[0]
        rows = rows if len(rows) else np.nonzero(x[:, 0] == kind)[0]
        rows = rows[np.argsort(-raw[rows], kind="stable")]
        right, seen = np.cumsum(y[rows]), np.cumsum(n[rows])
        # only where the score changes; scores below even odds are never selected
        last = np.append(np.diff(raw[rows]) < 0, True) if len(rows) else np.zeros(0, bool)
        good = np.nonzero(last & (right >= PRECISION * seen))[0]
        if len(good):
            thresholds[kind] = max(float(raw[rows[good[-1]]]) - 1e-6, 0.0)
    return Boosted(start, trees, thresholds)


def train(docs: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fit on what is planted into a sample of the documents, in one grouped count."""
    scratch = Scratch(docs.sparkSession, "planted")
    # a table between, or each pattern would put the items together anew
    each = scratch.table(labelled(scratch.table(planted(docs, sample), "planted")), "candidates")
    counted = each.groupBy((remainder("doc_id", 5) == 0).alias("held"), *[F.col(f"c.{n}").alias(n) for n in FEATURES])
    rows = counted.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("real").cast("int")).alias("real")).collect()
    scratch.clear(keep=[])
    cells = [({n: r[n] for n in FEATURES}, int(r["held"]), float(r["rows"]), float(r["real"])) for r in rows]
    cells.sort(key=lambda c: (c[1], *c[0].values()))
    return boost(cells)


def _apart(c: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _selected(model: Boosted, k: int, spans: Column):
    return lambda c: (c["kind"] == k) & ~c["base"] & model.selects(c) & _apart(c, spans)


def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _of_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def all_spans(base: dict[str, Column], found: Column, model: Boosted) -> dict[str, Column]:
    """(start, end) by kind, ascending: the base spans, and selected candidates clear of them and of earlier ones."""
    out = {}
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    for k, kind in enumerate(KINDS):
        plain = F.transform(base[kind], lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
        chosen = F.filter(found, _selected(model, k, base[kind]))
        chosen = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
        clear = F.aggregate(chosen, none, lambda a, c: F.when(_apart(c, a), F.concat(a, F.array(c))).otherwise(a))
        more = F.concat(plain, clear)
        out[kind] = F.array_sort(more)
    return out


def _written(spans: dict[str, Column]) -> Column:
    return F.concat_ws(",", F.concat(*[F.transform(spans[k], _named(k)) for k in KINDS]))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    scratch = Scratch(docs.sparkSession, "private")
    model = train(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = base_spans(F.col("text"))
    bare = {k: F.transform(spans[k], lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))) for k in KINDS}
    described = scratch.table(rows.select("doc_id", *[bare[k].alias(k) for k in KINDS], candidates(F.col("text")).alias("candidates")), "described")
    base = {k: F.col(k) for k in KINDS}
    every = _written(all_spans(base, F.col("candidates"), model))
    return described.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; overlapping spans are one, named by the first.

    A column ``n_chars`` gets the new length.  Null texts stay null.
    """
    model = train(docs)
    own = free_names(docs, *[f"_{k}" for k in KINDS], "_found", *[f"_all_{k}" for k in KINDS], "_spans", "_text")
    base_names, found_name, all_names, spans_name, text_name = own[:4], own[4], own[5:9], own[9], own[10]
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    # columns of their own, so that each pattern goes over a text once
    base = base_spans(text)
    tagged = docs.withColumns({**dict(zip(base_names, [base[k] for k in KINDS], strict=True)), found_name: candidates(text)})
    spans = all_spans({k: F.col(n) for k, n in zip(KINDS, base_names, strict=True)}, F.col(found_name), model)
    tagged = tagged.withColumns({n: spans[k] for k, n in zip(KINDS, all_names, strict=True)})
    every = F.array_sort(F.concat(*[F.transform(n, _of_kind(k)) for k, n in zip(KINDS, all_names, strict=True)]))
    tagged = tagged.withColumn(spans_name, every)
    whole = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        more = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(more)

    done = F.aggregate(spans_name, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(whole, a["at"] + 1, F.length(whole))))
    changed = F.when(F.size(spans_name) > 0, done).otherwise(F.col("`text`"))
    # a name of its own: beside an alias named text, a lambda's text would be taken for the new one
    tagged = tagged.withColumn(text_name, changed)
    new = {"text": F.col(text_name).alias("text"), "n_chars": F.length(text_name).cast("long").alias("n_chars")}
    return tagged.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
