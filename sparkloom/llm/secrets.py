"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens. DataFrame functions only.

A token of 20 or more characters of the alphabets below is tested for what random strings of its encoding show:
uniform use of the alphabet (chi-squared), as many runs above and below the middle of the alphabet as chance gives,
and no correlation of neighbours. The three are joined to one score, the lower the more random.

What is controlled is the share of false ones among the tokens reported as kind `random`, by length class. What
ordinary text scores is learnt from decoys: for each token, a stretch of the same length of the words around it, joined
in the token's own style (as they are, in camel case, or by underscores). A class reports tokens up to the greatest
score at which (1 + decoys so far) / (tokens so far) is at most the wanted share; with too few tokens it reports none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, text_or_empty

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched whole, so a shorter one cannot hold a longer match and the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 8
# The alphabets of the encodings in the order of their digits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
KINDS = ("assign", "access", "hex", "random")
#: Share of ordinary text among the tokens that are reported as random.
FALSE_DISCOVERIES = 0.05
#: Scores are held as steps of a tenth of a decade down to 1e-60, so that their counts stay few at any size.
STEPS, DEEPEST = 10, 600
CHUNK = 256


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def starts(gaps: Column, matches: Column) -> Column:
    """Code-point positions of matches, from what lies between them; sums go by chunks, so long texts stay near linear."""
    n = F.size(matches)
    steps = F.zip_with(F.slice(gaps, 1, n), matches, lambda g, m: F.length(g) + F.length(m))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(steps, k * CHUNK + 1, CHUNK))
    # what lies before each chunk is summed once a chunk
    bases = lambda sums: F.transform(sums, lambda _, k: _total(F.slice(sums, 1, k)))
    based = F.element_at(F.transform(F.array(F.transform(chunks, _total)), bases), 1)
    before = F.flatten(F.zip_with(chunks, based, lambda c, at: F.transform(c, lambda _, i: at + _total(F.slice(c, 1, i)))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.zip_with(before, F.slice(gaps, 1, n), lambda b, g: b + F.length(g)))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of all matches; texts without one are told apart by a plain search first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    at = starts(F.split(text, pattern, -1), found)
    spans = F.zip_with(at, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("token")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def _normal_tail(z: Column) -> Column:
    """P(Z >= z) for z >= 0 by the usual five-term rational form (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _wilson_hilferty(x: Column, df: Column) -> Column:
    """The normal score of a chi-squared value."""
    v = 2 / (9 * df)
    return (F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def encoding(token: Column) -> Column:
    s = F.regexp_replace(token, "=+$", "")
    return (
        F.when(s.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(s.rlike(r"^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def randomness_step(token: Column) -> Column:
    """A score in tenths of a decade, rounded down: 0 for what looks random, more for what does not."""
    kind = encoding(token)
    raw = F.regexp_replace(token, "=+$", "")
    s = F.when(kind == "hex", F.lower(raw)).otherwise(F.translate(raw, "-_", "+/"))
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    k = F.length(alphabet).cast("double")

    def scored(c: Column) -> Column:
        codes, k_, n = c["codes"], c["k"], F.size(c["codes"]).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0)))
        z1 = F.greatest(F.lit(0.0), _wilson_hilferty(squares * k_ / n - n, k_ - 1))
        above = F.aggregate(codes, F.lit(0.0), lambda a, x: a + F.when(x >= k_ / 2, 1.0).otherwise(0.0))
        below = n - above
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        runs = F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["x"] >= k_ / 2) != (p["y"] >= k_ / 2), 1.0).otherwise(0.0))
        mean = 2 * above * below / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z2 = F.when((above == 0) | (below == 0), F.sqrt(n)).when(var <= 0, 0.0).otherwise((runs - mean) / F.sqrt(var))
        middle = (k_ - 1) / 2
        spread = (k_ * k_ - 1) / 12
        z3 = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["x"] - middle) * (p["y"] - middle)) / (spread * F.sqrt(n - 1))
        z = _wilson_hilferty(z1 * z1 + z2 * z2 + z3 * z3, F.lit(3.0))
        p = F.when(z <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _normal_tail(z)))
        return F.least(F.lit(DEEPEST), F.floor(-F.log10(F.greatest(p, F.lit(1e-100))) * STEPS).cast("int"))

    codes = F.transform(F.split(s, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    # bound once: what follows names the array several times
    return F.element_at(F.transform(F.array(F.struct(codes.alias("codes"), k.alias("k"))), scored), 1)


def length_class(n: Column) -> Column:
    """Two classes to each doubling of the length."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def decoys(text: Column, spans: Column) -> Column:
    """For each span of a token (start, end, token) a stretch of the text's words, as long and in the token's style; null
    where the words are too few."""
    words = F.regexp_extract_all(F.regexp_replace(text, TOKEN, " "), F.lit("[A-Za-z]{2,}"), F.lit(0))

    def of(w: Column) -> Column:
        camel = F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))), "")
        styles = F.struct(camel.alias("camel"), F.array_join(w, "_").alias("under"), F.lower(camel).alias("plain"))

        def one(s: Column, st: Column) -> Column:
            n = s["end"] - s["start"]
            source = F.when(s["token"].rlike("[_/+=-]"), st["under"]).when(s["token"].rlike("[A-Z0-9]"), st["camel"]).otherwise(st["plain"])
            room = F.length(source) - n
            return F.when(room >= 0, F.substring(source, F.pmod(s["start"] * 31, F.greatest(room, F.lit(0)) + 1) + 1, n))

        return F.element_at(F.transform(F.array(styles), lambda st: F.transform(spans, lambda s: one(s, st))), 1)

    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(F.element_at(F.transform(F.array(words), of), 1))


def thresholds(scored: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length class of (class, step, decoy) the greatest step up to which tokens are reported; -1: none are.

    Counts by class and step come to the driver: at most 64 classes of twice 601 steps whatever the corpus holds.
    """
    counts: dict[int, dict[int, list[int]]] = {}
    for row in scored.where("step is not null").groupBy("class", "step", "decoy").count().collect():
        counts.setdefault(row["class"], {}).setdefault(row["step"], [0, 0])[row["decoy"]] += row["count"]
    out = {}
    for name, steps in counts.items():
        own = false = 0
        out[name] = -1
        for step in sorted(steps):
            own, false = own + steps[step][0], false + steps[step][1]
            if own and (1 + false) / own <= false_discoveries:
                out[name] = step
    return out


def scan(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """keys and spans array<struct<start, kind_no, kind, end>> of every row, by start and kind.

    A null or empty text has no spans. Repeated rows are scanned each by itself, but each adds to the counts that
    set the thresholds. An empty table gives an empty one; other columns are left out. Texts are scanned whole.
    """
    t = text_or_empty(f"`{text}`")
    base = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], t.alias("__t"))
    held = F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(
        F.zip_with(_spans(F.col("__t"), ASSIGN), held, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(F.length(v), F.lit(0)).alias("n"))),
        lambda s: s["n"] >= ASSIGN_LEAST,
    )

    def kind(spans: Column, no: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(KINDS[no]).alias("kind"), s["end"].alias("end")))

    spans = _spans(F.col("__t"), TOKEN)
    scored = lambda ss: F.zip_with(
        ss,
        decoys(F.col("__t"), ss),
        lambda s, d: F.struct(s["start"].alias("start"), s["end"].alias("end"), length_class(s["end"] - s["start"]).alias("class"), randomness_step(s["token"]).alias("step"), F.when(d.isNotNull(), randomness_step(d)).alias("decoy")),
    )
    tokens = F.element_at(F.transform(F.array(spans), scored), 1)
    found = Stored(
        base.select(
            *keys,
            F.when(F.col("__t").rlike(ASSIGN), kind(assigned, 0)).alias("assign"),
            kind(_spans(F.col("__t"), ACCESS), 1).alias("access"),
            kind(_spans(F.col("__t"), HEX), 2).alias("hex"),
            tokens.alias("tokens"),
        ),
        "secrets",
    ).df
    both = lambda x: F.array(F.struct(x["class"].alias("class"), x["step"].alias("step"), F.lit(0).alias("decoy")), F.struct(x["class"].alias("class"), x["decoy"].alias("step"), F.lit(1).alias("decoy")))
    limits = thresholds(found.select(F.inline(F.flatten(F.transform("tokens", both)))), false_discoveries)
    limit = F.create_map(*[F.lit(x) for kv in (limits or {-1: -1}).items() for x in kv])
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")
    fixed = F.array_sort(F.concat(F.coalesce("assign", empty), "access", "hex"))
    random = kind(F.filter("tokens", lambda x: x["step"] <= F.element_at(limit, x["class"])), 3)
    return found.withColumn("base", fixed).select(
        *keys,
        "base",
        F.array_sort(F.concat("base", F.filter(random, lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))).alias("spans"),
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    keys = [c for c in scanned.columns if c not in ("base", "spans")]
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(*keys, *map(count, KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
