"""Personal data by weak supervision (built-in functions only on the main path).

Candidate spans are all matches of four base patterns, those that fail their test included,
and of wider ones. Labelers vote on each candidate, for, against or not at all: regular
expressions and checksums on its form, gazetteers on its parts, and context labelers on cue
words beside it. Expectation-maximisation over the counts of vote patterns (a fixed number of
rows) estimates how often each labeler votes which way on true and on false spans; its
posteriors train a logistic span classifier over the votes and two shape features, which
decides on the candidates that no base pattern settles. Base spans always stay.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

KINDS = ("email", "ip", "card", "phone")

# Base patterns. A possessive run and a look-behind keep them linear in the length of a text: within
# one run of characters every start succeeds or fails like the first, unless the last match ended inside it (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{2,63}+"
    r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\[\.\][0-9]{1,3}\[?\.\]?[0-9]{1,3}\[?\.\]?[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+)\x20-])\x20?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
# A cheap test that a text must pass before the patterns of a kind are tried.
RARE = {"email": "@|(?i)\\[at\\]|\\(at\\)|\\{at\\}", "ip": "[0-9]\\[?\\.", "card": "[0-9]", "phone": "\\+[0-9]|[0-9][.-][0-9]|[0-9]\\)"}

# Gazetteers. Domain endings: the generic ones below and any two letters (countries).
GENERIC = (
    "com org net edu gov mil int info biz name pro museum aero coop jobs mobi travel tel cat asia post xxx app dev page blog shop store "
    "online site tech cloud email live news media agency digital group team work world life space website example test invalid local"
).split()
# Card issuers as (first digits, numbers of digits).
ISSUERS = (
    ("4", "13|16|19"), ("5[1-5]", "16"), ("222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720", "16"), ("3[47]", "15"), ("6011|64[4-9]|65", "16|17|18|19"),
    ("352[89]|35[3-8][0-9]", "16|17|18|19"), ("30[0-5]|36|3[89]", "14|15|16|17|18|19"), ("62", "16|17|18|19"), ("50|5[6-9]|6[037]", "13|14|15|16|17|18|19"),
)
# Country calling codes: of one and two digits, else any three that begin like a zone; a North American number has area
# and exchange codes that begin with 2 to 9.
CALLING = "1[2-9][0-9]{2}[2-9]|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9]"
# Networks that name no host: this network, loopback, link-local, multicast and reserved.
NOWHERE = "0|127|169\\.254|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
CUES = {
    "email": "e-?mails?|mailto|contact|write to|reach|inbox|correo|courriel|kontakt|schreiben",
    "ip": "ips?|hosts?|server|address|login|client|router|ping|adresse|dirección",
    "card": "cards?|visa|mastercard|amex|credit|payment|debit|iban|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|dial|whatsapp|telefon|teléfono|téléphone|appel|rufen",
}
AGAINST = "orders?|invoice|version|isbn|issn|serial|ticket|sku|build|page|section|release|rev|part|model|lot|id|ref|no|nr|rechnung|factura|facture|bestellung|pedido"
WINDOW = 40  # characters of context on either side
LABELERS = ("form", "gazetteer", "cue", "against")
SHAPES = ("plain", "first")
FEATURES = (*LABELERS, *SHAPES)
ROUNDS, ACCEPT = 50, 0.9
# Before any data: chances of a vote for, against and of none on a true and on a false span, worth STRENGTH votes each.
BELIEFS = {
    "form": ((0.70, 0.05, 0.25), (0.20, 0.60, 0.20)),
    "gazetteer": ((0.60, 0.10, 0.30), (0.25, 0.45, 0.30)),
    "cue": ((0.40, 0.01, 0.59), (0.04, 0.01, 0.95)),
    "against": ((0.01, 0.03, 0.96), (0.01, 0.40, 0.59)),
}
STRENGTH = 20.0
VOTES = (1, 0, -1)


def _found(kind: str, pattern: str, wide: bool) -> Column:
    """Leftmost non-overlapping matches in a text, in order: (kind, wide, pos, span, gap, left, right). The pieces between
    the matches and the matches alternate, so running lengths give the offsets later on."""
    hits, pieces = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), pieces.alias("gap"), F.slice(pieces, 2, F.size(pieces)).alias("next"))
    listed = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("pos"), x["hit"].alias("span"), F.length(x["gap"]).alias("gap"),
            F.right(x["gap"], F.lit(WINDOW)).alias("left"), F.left(x["next"], F.lit(WINDOW)).alias("right"),
        ),
    )
    return F.when(F.col("text").rlike(RARE[kind]), F.filter(listed, lambda x: x["span"].isNotNull()))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, found): one stored row per row of ``docs`` with all its matches. Texts are read here and nowhere else, so
    row numbers and spans belong together however ``docs`` was made and whatever is computed again."""
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    lists = [F.coalesce(_found(k, p[k], w), F.array().cast(MATCHES)) for p, w in ((BASE, False), (WIDE, True)) for k in KINDS]
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.concat(*lists).alias("found")), "pii-matches")


MATCHES = "array<struct<kind:string,wide:boolean,pos:int,span:string,gap:int,left:string,right:string>>"


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.split(F.reverse(number), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1))
    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _address(span: Column) -> Column:
    """Whether all parts of an address are at most 255, however many zeros they begin with."""
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
    return F.forall(F.split(span, "\\."), small)


def passes() -> Column:
    """The test that a match of a base pattern must pass to be a base span."""
    span, n = F.col("span"), F.length(digits(F.col("span")))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", _address(span))
        .when(F.col("kind") == "card", F.when(n.between(13, 19), luhn(digits(span))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def candidates(found: DataFrame) -> DataFrame:
    """(row, kind, base, start, end, span, left, right) of all matches, in code points. Matches that could not be of their
    kind at all (bare runs of fewer than 13 or more than 19 digits as cards) are no candidates."""
    each = found.select("row", F.explode("found").alias("m")).select("row", "m.*")
    upto = Window.partitionBy("row", "kind", "wide").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("span")).over(upto)
    placed = each.withColumn("end", end.cast("long")).withColumn("base", ~F.col("wide") & passes())
    number = F.length(digits(F.col("span")))
    possible = F.col("wide") | F.col("base") | F.when(F.col("kind") == "card", number.between(13, 19)).when(F.col("kind") == "phone", number.between(7, 16)).otherwise(True)
    return placed.where(possible).select("row", "kind", "base", (F.col("end") - F.length("span")).alias("start"), "end", "span", "left", "right")


def votes(spans: DataFrame) -> DataFrame:
    """Votes 1, 0 (against) or -1 (none) of the labelers, and the shape features."""
    kind, span = F.col("kind"), F.col("span")
    near = F.lower(F.concat_ws(" ", "left", F.lit("|"), "right"))
    number = digits(span)
    yes = lambda c: F.when(c, 1).otherwise(0)
    form = (
        F.when(kind == "email", yes(span.rlike("^[A-Za-z0-9]") & ~span.rlike("\\.\\.|[.-]@|@-")))
        .when(kind == "ip", yes(_address(F.regexp_replace(span, "[\\[\\]]", ""))))
        .when(kind == "card", yes(luhn(number)))
        .otherwise(F.when(F.length(number).between(9, 15) & span.rlike("^\\+"), 1).otherwise(F.when(F.length(number) == 10, -1).otherwise(0)))
    )
    domain = F.lower(F.regexp_extract(span, "([A-Za-z]+)\\W*$", 1))
    issued = F.lit(False)
    for first, sizes in ISSUERS:
        issued = issued | (number.rlike(f"^(?:{first})") & F.length(number).isin([int(n) for n in sizes.split("|")]))
    called = F.when(span.rlike("^\\+"), number.rlike(f"^(?:{CALLING})")).otherwise(number.rlike("^1?[2-9][0-9]{2}[2-9]"))
    gazetteer = (
        F.when(kind == "email", yes((F.length(domain) == 2) | domain.isin(GENERIC)))
        .when(kind == "ip", F.when(span.rlike(f"^(?:{NOWHERE})\\b"), 0).otherwise(-1))
        .when(kind == "card", yes(issued))
        .otherwise(yes(called))
    )
    cue = F.lit(-1)
    for k in KINDS:
        cue = F.when((kind == k) & near.rlike(f"(?<!\\p{{L}})(?:{CUES[k]})(?!\\p{{L}})"), 1).otherwise(cue)
    against = F.when(F.lower(F.col("left")).rlike(f"(?<!\\p{{L}})(?:{AGAINST})\\W*$"), 0).otherwise(-1)
    return spans.select(
        "*", form.cast("int").alias("form"), gazetteer.cast("int").alias("gazetteer"), cue.cast("int").alias("cue"),
        against.cast("int").alias("against"), F.when(span.rlike("[\\[({]"), 0).otherwise(1).alias("plain"),
        F.when(F.col("left").rlike("(^|\\s)$") | (F.col("left") == ""), 1).otherwise(0).alias("first"),
    )


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


Rates = list[tuple[dict[int, float], dict[int, float]]]


def posterior(vote: tuple[int, ...], prior: float, rates: Rates) -> float:
    """Chance that a span with these votes is true, votes being independent given that."""
    return _sigmoid(math.log(prior / (1 - prior)) + sum(math.log(t[v] / f[v]) for v, (t, f) in zip(vote, rates)))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, Rates, list[float]]:
    """EM for the two-class vote model: prior, for each labeler the chances of its votes on true and on false spans, and the
    posterior per pattern. ``patterns`` are (votes, count). A missing vote is an outcome like the others, so a labeler that
    only ever votes against counts too; the beliefs enter as counts and steer few data."""
    start = [tuple(dict(zip(VOTES, side)) for side in BELIEFS[name]) for name in LABELERS]
    prior, rates = 0.5, list(start)
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        post = [posterior(vote, prior, rates) for vote, _ in patterns]
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        rates = []
        for j, believed in enumerate(start):
            sides = []
            for side, chance in enumerate(believed):
                mass = {v: STRENGTH * chance[v] for v in VOTES}
                for p, (vote, n) in zip(post, patterns):
                    mass[vote[j]] += n * (p if side == 0 else 1 - p)
                whole = sum(mass.values())
                sides.append({v: m / whole for v, m in mass.items()})
            rates.append(tuple(sides))
    return prior, rates, [posterior(vote, prior, rates) for vote, _ in patterns]


def _inputs(f: tuple[int, ...]) -> list[float]:
    """A vote for, a vote against, for each labeler; then the shapes."""
    return [float(v == want) for v in f[: len(LABELERS)] for want in (1, 0)] + [float(v) for v in f[len(LABELERS) :]]


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b for a small symmetric positive matrix."""
    n = len(b)
    rows = [list(r) + [y] for r, y in zip(a, b)]
    for i in range(n):
        for j in range(i + 1, n):
            share = rows[j][i] / rows[i][i]
            rows[j] = [y - share * x for x, y in zip(rows[i], rows[j])]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def train_classifier(rows: list[tuple[tuple[int, ...], float, float]], ridge: float = 1e-3, steps: int = 25) -> list[float]:
    """Weights and bias of a ridge logistic classifier of (features, weight, posterior), by Newton steps of limited size."""
    total = sum(n for _, n, _ in rows) or 1
    data = [(_inputs(f) + [1.0], n / total, p) for f, n, p in rows]
    width = 2 * len(LABELERS) + len(SHAPES) + 1
    w = [0.0] * width
    for _ in range(steps):
        g = [-ridge * x for x in w]
        h = [[ridge if i == j else 0.0 for j in range(width)] for i in range(width)]
        for x, n, p in data:
            q = _sigmoid(sum(a * b for a, b in zip(w, x)))
            at = [i for i, v in enumerate(x) if v]
            for i in at:
                g[i] += n * (p - q) * x[i]
                for j in at:
                    h[i][j] += n * q * (1 - q) * x[i] * x[j]
        move = _solved(h, g)
        short = min(1.0, 2.0 / max(map(abs, move)) if any(move) else 1.0)
        w = [a + short * b for a, b in zip(w, move)]
    return w


def span_classifier(patterns: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """Classifier of one kind from the counts of its feature patterns. All vote patterns that the model allows stand beside
    those met, with a total weight of STRENGTH, so that what was never met is decided by the reliabilities."""
    votes_of = [(f[: len(LABELERS)], n) for f, n in patterns]
    prior, rates, post = reliabilities(votes_of)
    rows = [(f, float(n), p) for (f, n), p in zip(patterns, post)]
    grid = list(product(VOTES, repeat=len(LABELERS)))
    shapes = list(product((0, 1), repeat=len(SHAPES)))
    rows += [(v + s, STRENGTH / len(grid) / len(shapes), posterior(v, prior, rates)) for v in grid for s in shapes]
    return train_classifier(rows)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: row, id), (spans: row, kind, base, start, end, span, probability).

    Offsets are code points, end exclusive. Null and empty texts have no spans; rows repeated under an id, and rows
    without one, are searched each. Added spans overlap no base span, and of added spans that overlap the one that
    starts first (then the likelier, then the longer) stays. Very long texts are searched whole. An empty table gives
    two empty ones.
    """
    found = matches(docs, id_col, text_col)
    voted = stored(votes(candidates(found)), "pii-candidates")
    counted = voted.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()  # a fixed number of patterns
    chance = F.lit(0.0)
    for kind in KINDS:
        own = sorted((tuple(r[f] for f in FEATURES), r["n"]) for r in counted if r["kind"] == kind)
        w = span_classifier(own)
        terms = [(F.col(name) == want).cast("double") for name in LABELERS for want in (1, 0)] + [F.col(name).cast("double") for name in SHAPES]
        z = F.lit(w[-1])
        for x, term in zip(w, terms):
            z = z + F.lit(x) * term
        chance = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(chance)
    judged = voted.withColumn("probability", F.round(chance, 9)).where(F.col("base") | (F.col("probability") >= ACCEPT))
    columns = ["row", "kind", "base", "start", "end", "span", "probability"]
    return found.select("row", "id"), _apart(judged).select(columns)


def _apart(judged: DataFrame) -> DataFrame:
    """Base spans and the added ones that overlap neither them nor an added one before them."""
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), F.col("probability").desc(), F.col("end").desc(), "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("base")
    ends, starts = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(after)
    free = base | ((F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(starts, F.col("end")) >= F.col("end")))
    kept = judged.withColumn("free", free).where("free")
    reached = F.max(F.when(~base, F.col("end"))).over(before)
    return kept.withColumn("reached", reached).where(base | (F.coalesce("reached", F.lit(0)) <= F.col("start")))


def _listed(only_base: bool) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    key = F.struct(rank[F.col("kind")].alias("k"), F.col("start"), F.concat_ws(":", "kind", "start", "end").alias("at"))
    return F.collect_list(F.when(F.col("base"), key) if only_base else key)


def digests(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    rows, spans = found
    per = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        _listed(True).alias("b"), _listed(False).alias("a"), F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["at"]), ",")
    per = per.select("row", *[f"n_{k}" for k in KINDS], "n_added", text("b").alias("b"), text("a").alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(per, "row", "left").select(
        F.col("id").alias("doc_id"), *[zero(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("a", F.lit("")).alias("spans"), zero("n_added"),
    )
