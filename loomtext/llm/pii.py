"""Personal data by weak supervision, in DataFrame functions only.

Base spans of four kinds come from fixed patterns and checks and always stay. Beside them, looser patterns propose
candidates of two more kinds: `secret` (runs of letters and digits) and `number` (groups of digits). Five labelers vote
for (1), against (-1) or not at all (0) on every base match and candidate: the strict pattern, a checksum or range, a
gazetteer of cue words and prefixes, the characters around, and assignment signs before. Expectation-maximisation over
the counts of vote patterns, at most 3 ** 5 rows for each kind, estimates each labeler's reliability for that kind and
each pattern's probability; with these as soft labels a naive Bayes classifier by kind over a few bounded features is
trained, and candidates that it finds likelier than not are added where no base span is. All counts are over all documents.

Matches are leftmost and non-overlapping; a match that fails its check is dropped without another try. Start and end
are code points, end exclusive. Patterns are written so that the regex engine neither recurses nor scans a run twice.

Null texts count as empty and have no spans; repeated rows are counted and reported each; without any candidate, or
in an empty table, nothing is added.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import drop_path, stored

# Kinds in the order of the contract, and their patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = 4
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+",
    r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])",
)
#: Cue words of each kind's gazetteer, in lower case, in the languages of the texts.
CUES = (
    "mail|contact|correo|courriel|kontakt|write|reach|@",
    r"\bip\b|host|server|address|adresse|serveur|servidor|direcci|gateway|ping|node",
    "card|visa|credit|mastercard|amex|payment|carte|karte|tarjeta|paiement|zahlung|pago|konto|iban",
    "phone|tel|call|mobile|fax|handy|anruf|appel|portable|llam|movil|whatsapp|sms",
    "password|passwd|passwort|contrase|mot de passe|pwd|token|secret|key|schl|clave|credential|bearer|auth|login",
    "phone|tel|call|mobile|fax|handy|ssn|social|passport|reisepass|passeport|pasaporte|license|ausweis",
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Rounds of expectation-maximisation, characters of context, elements of a block of running sums.
ROUNDS, CONTEXT, BLOCK = 15, 24, 256
LABELERS = 5
#: Forms that keys and tokens are known to have.
SECRET = r"^(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9_-]{20,})\z"


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks, so that the work stays near its length."""

    def plain(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))
        return F.aggregate(values, zero, step, lambda acc: acc["a"])

    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda i: F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK)))
    before = plain(F.transform(blocks, total))
    shifted = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("t")), lambda z: F.transform(plain(z["b"]), lambda x: x + z["t"] - total(z["b"]))))
    return F.when(F.size(lengths) <= BLOCK, plain(lengths)).otherwise(shifted)


def _with_matches(df: DataFrame) -> DataFrame:
    """Columns s0 to s5: arrays of (kind, start, end, match, left, right) of each pattern's matches in `text`."""
    digit = F.col("text").rlike("[0-9]")
    gates = (F.contains("text", F.lit("@")), digit, digit, F.contains("text", F.lit("+")) & digit, digit, digit)
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(g, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{i}") for i, (g, p) in enumerate(zip(gates, PATTERNS, strict=True))))
    df = df.select("*", *(F.when(F.size(f"m{i}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PATTERNS)))
    lengths = [F.zip_with(F.slice(f"p{i}", F.lit(1), F.size(f"m{i}")), f"m{i}", lambda p, m: (F.length(p) + F.length(m)).cast("bigint")) for i in range(len(KINDS))]
    ends = [F.when(F.size(f"m{i}") > 0, _running(x)).otherwise(F.array().cast("array<bigint>")).alias(f"e{i}") for i, x in enumerate(lengths)]
    df = df.select("*", *ends)

    def spans(i: int) -> Column:
        def one(m: Column, at: Column) -> Column:
            end = F.col(f"e{i}")[at]
            return F.struct(
                F.lit(i).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"),
                F.lower(F.right(F.col(f"p{i}")[at], F.lit(CONTEXT))).alias("left"), F.left(F.col(f"p{i}")[at + 1], F.lit(1)).alias("right"),
            )

        return F.transform(F.col(f"m{i}"), one)

    return df.select("*", *(spans(i).alias(f"s{i}") for i in range(len(KINDS)))).drop(*(f"{c}{i}" for c in "mpe" for i in range(len(KINDS))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: int, match: Column) -> Column:
    """The check of a base kind."""
    n = F.length(_digits(match))
    return (
        F.lit(True),
        match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}\z"),
        (n >= 14) & (n <= 19) & F.when((n >= 14) & (n <= 19), _luhn(match)).otherwise(False),
        (n >= 10) & (n <= 15),
    )[kind]


def _features(s: Column) -> dict[str, Column]:
    """Bounded features of a span beside its kind."""
    n = F.length(s["match"])
    share = F.length(_digits(s["match"])) / n
    chars = lambda c: F.when(c == "", "edge").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "blank").when(c.rlike("[=:\"']"), "sign").otherwise("other")
    return {
        "size": F.least(F.floor(n / 4), F.lit(8)).cast("string"),
        "digits": F.floor(share * 4).cast("string"),
        "before": chars(F.right(s["left"], F.lit(1))),
        "after": chars(s["right"]),
        "cue": _by_kind(s, lambda k: s["left"].rlike(CUES[k])).cast("string"),
    }


def _by_kind(s: Column, of) -> Column:
    return reduce(lambda out, k: out.when(s["kind"] == k, of(k)), range(1, len(KINDS)), F.when(s["kind"] == 0, of(0)))


def _votes(s: Column) -> list[Column]:
    """Votes of the five labelers on a span."""
    m, n = s["match"], F.length(_digits(s["match"]))
    share = n / F.length(m)
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    strict = (
        vote(m.rlike(r"\.[A-Za-z]{2,}\z"), ~m.rlike(r"\.[A-Za-z]{2,}\z")), vote(m.rlike(r"^(?:[1-9]?[0-9]{1,2}\.){3}[0-9]{1,3}\z")), vote((n >= 14) & (n <= 19), (n < 14) | (n > 19)),
        vote((n >= 10) & (n <= 15), (n < 10) | (n > 15)), vote(m.rlike(SECRET), m.rlike(r"^[A-Za-z]+(?:[-_][A-Za-z]+)*[-_]?[0-9]{1,4}\z|^[0-9]+(?:[-_][0-9]+)*[-_]?[A-Za-z]{1,3}\z")), vote(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z|^\([0-9]{3}\)"), (n < 7) | m.rlike(r"^[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}\z|^[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{4}\z")),
    )
    check = (vote(~m.contains(".."), m.startswith(".")), vote(_passes(1, m), ~_passes(1, m)), vote(_passes(2, m), ~_passes(2, m)), vote(n == 11, n < 10), vote((share > 0.15) & (share < 0.85), (share <= 0.1) | (share >= 0.95)), vote(n.isin(9, 10), ~n.isin(9, 10)))
    known = (r"@[^@]*\.(?:com|org|net|edu|gov|io|de|fr|es|uk)\z", r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.", "^[3-6]", r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])", "^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ)", r"^\(?[2-9][0-9]{2}\)?[ .-]")
    side = lambda c: (c == "") | c.rlike(r"[^A-Za-z0-9]")
    around = vote(side(F.right(s["left"], F.lit(1))) & side(s["right"]), s["right"].rlike("[A-Za-z0-9]"))
    signs = vote(s["left"].rlike(r"[=:]\s*[\"']?\z"))
    pick = lambda given: _by_kind(s, lambda k: given[k])
    return [pick(strict), pick(check), _by_kind(s, lambda k: vote(s["left"].rlike(CUES[k]) | m.rlike(known[k]))), around, signs]


#: Half a round: the patterns' probabilities under the weights w, summed by labeler and vote. w holds the log ratio of
#: each labeler's votes, three for each labeler, and at its end the log odds of the classes.
MASSES = """aggregate(t, array_repeat(0D, size(w)), (sums, x) -> element_at(transform(
  array(x.n / (1 + exp(-aggregate(zip_with(x.one, w, (o, c) -> o * c), 0D, (p, c) -> p + c)))),
  mass -> zip_with(sums, x.one, (p, o) -> p + o * mass)), 1))"""


def _fit(counts: DataFrame) -> DataFrame:
    """Rows (kind, votes, n) -> (kind, votes, n, q): expectation-maximisation in one row for each kind, folded over ROUNDS."""
    spread = "concat(flatten(transform(votes, v -> array(double(v = -1), double(v = 0), double(v = 1)))), array(1D))"
    rows = counts.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")).withColumn("one", F.expr(spread))
    table = rows.groupBy("kind").agg(F.collect_list(F.struct("votes", "n", "one")).alias("t"))
    width = 3 * LABELERS + 1
    table = table.withColumn("total", F.expr(f"aggregate(t, array_repeat(0D, {width}), (s, x) -> zip_with(s, x.one, (p, o) -> p + o * x.n))"))
    start = ", ".join(["ln(0.05 / 0.35), ln(0.35 / 0.45), ln(0.6 / 0.2)"] * LABELERS)  # trust labelers a little
    new = f"""transform(sequence(1, {width}), j -> IF(j = {width}, ln((yes[j - 1] + 1) / (total[j - 1] - yes[j - 1] + 1)),
      ln((yes[j - 1] + 0.3) / (yes[{width - 1}] + 1)) - ln((total[j - 1] - yes[j - 1] + 0.3) / (total[{width - 1}] - yes[{width - 1}] + 1))))"""
    fold = f"aggregate(sequence(1, {ROUNDS}), array({start}, 0D), (w, r) -> element_at(transform(array({MASSES}), yes -> {new}), 1))"
    fitted = table.withColumn("w", F.expr(fold)).select("kind", "w", F.explode("t").alias("x"))
    q = "1 / (1 + exp(-aggregate(zip_with(x.one, w, (o, c) -> o * c), 0D, (p, c) -> p + c)))"
    return fitted.select("kind", F.col("x.votes").alias("votes"), F.col("x.n").alias("n"), F.expr(q).alias("q"))


def train(df: DataFrame, text: str = "text") -> dict:
    """The classifier: by kind, the log odds of all (bias) and of each feature's value (odds), and `reliable`, each vote
    pattern's count and probability.

    What reaches the driver is a row for each kind, value of a feature and vote pattern, some hundreds at any input size.
    """
    rows = _with_matches(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    spans = rows.select(F.explode(F.concat(*(f"s{i}" for i in range(len(KINDS))))).alias("s"))
    s, names = F.col("s"), list(_features(F.col("s")))
    counts = spans.select(s["kind"].alias("kind"), F.array(*_votes(s)).alias("votes"), *(c.alias(n) for n, c in _features(s).items())).groupBy("kind", "votes", *names).agg(F.count(F.lit(1)).alias("n"))
    counts, path = stored(counts, "votes")
    fitted, fit_path = stored(_fit(counts), "reliabilities")
    soft = counts.join(fitted.select("kind", "votes", "q"), ["kind", "votes"])
    values = soft.select("kind", "n", "q", F.explode(F.array(F.lit(""), *(F.concat(F.lit(f"{name}="), F.col(name)) for name in names))).alias("value"))
    masses = values.groupBy("kind", "value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    total = {r["kind"]: (r["yes"] + 1, r["no"] + 1) for r in masses if not r["value"]}
    odds = {f"{r['kind']}:{r['value']}": log((r["yes"] + 0.5) / total[r["kind"]][0] / ((r["no"] + 0.5) / total[r["kind"]][1])) for r in masses if r["value"]}
    found = {"bias": {k: log(yes / no) for k, (yes, no) in total.items()}, "odds": odds, "reliable": {(r["kind"], tuple(r["votes"])): (r["n"], r["q"]) for r in fitted.collect()}}
    for p in (path, fit_path):
        drop_path(df.sparkSession, p)
    return found


def find_spans(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, text, columns in `keep`, base, spans): arrays of (start, kind, end), in the order of start and kind."""
    rows = _with_matches(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep))
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    valid = lambda i: F.filter(f"s{i}", lambda s: _passes(i, s["match"]))
    base = F.array_sort(F.flatten(F.array(*(F.transform(valid(i), short) for i in range(BASE)))))
    rows = rows.select("*", base.alias("base"))
    extra = F.flatten(F.array(*(F.col(f"s{i}") for i in range(BASE, len(KINDS)))))
    if model["odds"]:
        table = F.create_map(*[x for k, v in sorted(model["odds"].items()) for x in (F.lit(k), F.lit(v))])
        bias = F.create_map(*[x for k, v in sorted(model["bias"].items()) for x in (F.lit(k), F.lit(v))])

        def likely(s: Column) -> Column:
            score = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(table, F.concat(s["kind"].cast("string"), F.lit(f":{n}="), c)), F.lit(0.0)) for n, c in _features(s).items()])
            return score + F.try_element_at(bias, s["kind"]) > 0

        free = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        added = F.transform(F.filter(extra, lambda s: likely(s) & free(s)), short)
        every = F.when(F.size(extra) > 0, F.array_sort(F.concat(F.col("base"), added))).otherwise(F.col("base"))
    else:
        every = F.col("base")
    return rows.select(key, "text", *keep, "base", every.alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, of the first's kind."""
    apart = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.array(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), F.array(*map(F.lit, KINDS))[s["kind"]], F.lit(">")))).alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, apart).otherwise(F.col(text))
