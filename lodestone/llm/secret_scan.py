"""Secret scan in DataFrame functions only: fixed rules, and character Markov models of random strings and ordinary ones.

Rules find assignments, access keys and long hexadecimal runs. Outside their spans, every run of 16 or more key characters,
whatever its mix, is judged by two first-order character models, one of random strings and one of ordinary identifiers and words:
the log-likelihood ratios of its different transitions. A transition counts once, as its repeats are no further evidence (else any
run of one letter would be clear evidence). With DIFFERENT of them or more, a mean of at least MARGIN and a sum of at least the model's evidence it
is a secret.

The models are counted from labelled samples with add-SMOOTHING: generated random strings and identifiers, repeated and
sequential runs, and all documents of the corpus, whose different values of rule matches are random and whose other
different runs of key characters are ordinary. A fifth of the samples is held out: the evidence asked for is
CLEARANCE times what all but a thousandth of the ordinary ones held out reach, and at least EVIDENCE.

Positions are code points with the end exclusive. They come from splitting the text at the matches: a match begins after all
gaps and matches before it. Running sums take doubling steps and texts are rebuilt from blocks, so time grows with
n log n in the number of matches and linearly in the text.

Cases: null and empty texts have no spans; matches that fail their length are dropped after matching, as a match
consumes its text either way; null and repeated ids keep their rows; without any document the generated samples train alone; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the rules: kind, pattern, group that is measured, least length of it.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What a text must hold for a rule to be tried at all; each is implied by a match that is long enough.
NEEDED = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: The same maximal runs with their length in the pattern, so that short runs aren't listed.
LONG = {"hex": r"(?<![0-9a-f])[0-9a-f]{32,}"}
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
MARGIN = 0.6  # least mean log-likelihood ratio of a run's different transitions
EVIDENCE, CLEARANCE = 10.0, 1.3  # least sum of them, at least; and as a multiple of what ordinary runs held out reach
DIFFERENT = 8  # least number of them: runs of a short period have few, random ones of 16 characters 12 or more
SMOOTHING = 0.1
PIECE = 64  # longest piece of a run in the samples
BLOCK = 4096  # characters of a block where texts and runs are taken apart

#: Parts of ordinary identifiers for the built-in sample.
WORDS = (
    "account address amount array base batch block buffer cache call center change channel child class client code color column "
    "command config content context control count create current customer data date default delete detail device display document "
    "domain email entry error event field file filter first format frame group handle header height image index input invoice item "
    "label language last layer length level line link list local location log main manager map message method model module name "
    "network number object option order output owner page parent path payment phone position process product profile query "
    "region report request response result return role root rule schedule script search section select server service session "
    "setting shape share signal size source stage start state status stream string style system table target task template test text "
    "thread time title total trace type update upload user value vector version view widget width window worker"
).split()


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of all transitions, row by row over ALPHABET, and the least sum that makes a secret."""

    ratios: list[float]
    evidence: float = EVIDENCE
    margin: float = MARGIN


def builtin_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (text, random): n seeded random strings in four alphabets, n identifiers in seven styles, and runs that repeat or count."""
    words = "split('" + " ".join(WORDS) + "', ' ')"
    pick = lambda k: f"element_at({words}, cast(pmod(xxhash64(id, {k}), {len(WORDS)}) AS int) + 1)"
    number = "pmod(xxhash64(id, 9), 2100)"
    alnum = lambda tag: f"regexp_replace(base64(unhex(sha2(concat('{tag}', id), 256))), '[+/=]', '')"
    randoms = spark.range(n).selectExpr(
        "CASE pmod(id, 4) WHEN 0 THEN substring(base64(unhex(sha2(concat('a', id), 256))), 1, 40)"
        " WHEN 1 THEN substring(sha2(concat('b', id), 256), 1, 40)"
        f" WHEN 2 THEN upper(substring({alnum('c')}, 1, 32)) ELSE substring({alnum('d')}, 1, 32) END AS text",
        "true AS random",
    )
    ordinary = spark.range(n).selectExpr(
        f"CASE pmod(id, 7) WHEN 0 THEN concat_ws('_', {pick(1)}, {pick(2)}, {number}, {pick(3)})"
        f" WHEN 1 THEN concat({pick(1)}, initcap({pick(2)}), initcap({pick(3)}), {number})"
        f" WHEN 2 THEN concat_ws('/', {pick(1)}, {pick(2)}, {pick(3)}, {number})"
        f" WHEN 3 THEN upper(concat_ws('_', {pick(1)}, {pick(2)}, {pick(3)})) WHEN 4 THEN concat_ws('-', {pick(1)}, {pick(2)}, {pick(3)})"
        f" WHEN 5 THEN concat({pick(1)}, {pick(2)}, {pick(3)}) ELSE concat(initcap({pick(1)}), initcap({pick(2)}), initcap({pick(3)})) END AS text",
        "false AS random",
    )
    # each run as often as 20 identifiers
    letters = f"split('{ALPHABET}', '')"
    runs = f"concat(transform({letters}, c -> repeat(c, 24)), array(repeat('0123456789', 3), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))"
    regular = spark.range(20).selectExpr(f"explode({runs}) AS text", "false AS random")
    return randoms.unionByName(ordinary).unionByName(regular)


def corpus_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples (text, random) of all documents: the different values that the rules find, and the different runs outside of them."""
    df = _masked(_rule_spans(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))))
    key = "[A-Za-z0-9+/_=-]"
    ordinary = f"transform(array_distinct(regexp_extract_all(masked_, {_quoted(key + '{6,' + str(PIECE) + '}')}, 0)), x -> named_struct('text', x, 'random', false))"
    values = "concat(" + ", ".join(f"CASE WHEN size(spans_{k}) > 0 THEN regexp_extract_all(text_, {_quoted(LONG.get(k, p))}, {g}) ELSE array() END" for k, p, g, _ in RULES) + ")"
    found = f"transform(flatten(transform(filter({values}, v -> length(v) >= 16), v -> regexp_extract_all(v, '.{{1,{PIECE}}}', 0))), x -> named_struct('text', x, 'random', true))"
    return df.select(F.expr(f"inline(concat({ordinary}, {found}))")).distinct()


def train(samples: DataFrame) -> Model:
    """A model of samples (text, random); texts of more than PIECE characters are taken in pieces."""
    fifth = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)) == 0
    samples = samples.where("text IS NOT NULL").select("random", F.expr(f"explode(regexp_extract_all(text, '.{{1,{PIECE}}}', 0)) AS text")).withColumn("held", fifth)
    k = len(ALPHABET)
    pairs = samples.where("NOT held").selectExpr("random", f"explode({_codes('text', '0')}) AS code").where("code > 0")
    count = {(side, code): 0 for side in (True, False) for code in range(1, k * k + 1)}
    for r in pairs.groupBy("random", "code").count().collect():  # at most 2 k^2 rows
        count[r["random"], r["code"]] = r["count"]
    ratios = []
    for a in range(k):
        total = {side: sum(count[side, a * k + b] for b in range(1, k + 1)) for side in (True, False)}
        for b in range(1, k + 1):
            p, q = ((count[side, a * k + b] + SMOOTHING) / (total[side] + SMOOTHING * k) for side in (True, False))
            ratios.append(round(math.log(p / q), 6))
    reached = samples.where("held AND NOT random AND length(text) >= 16").select(F.expr(f"({_judged('text', ratios)}).t AS t"))
    top = reached.agg(F.percentile_approx("t", 0.999, 10_000)).first()[0]
    return Model(ratios, round(max(EVIDENCE, CLEARANCE * (top or 0.0)), 6))


def model_of(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of generated samples and of the whole corpus."""
    return train(builtin_samples(docs.sparkSession).unionByName(materialize(corpus_samples(docs, text_col), "samples")))


def _codes(run: str, before: str) -> str:
    """Numbers of the transitions of a run, from 1; 0 where one of two characters is none of ALPHABET. before: number of the character before it."""
    places = f"transform(split({run}, ''), ch -> instr('{ALPHABET}', ch))"
    return f"zip_with(concat(array({before}), slice({places}, 1, length({run}) - 1)), {places}, (a, b) -> CASE WHEN a = 0 OR b = 0 THEN 0 ELSE (a - 1) * {len(ALPHABET)} + b END)"


def _judged(run: str, ratios: list[float]) -> str:
    """Struct of the sum t and number n of the log-likelihood ratios of a run's different transitions; block by block, the last character carried along."""
    table = "array(" + ",".join(f"{x}D" for x in ratios) + ")"
    step = f"named_struct('p', instr('{ALPHABET}', right(block, 1)), 'seen', array_union(acc.seen, {_codes('block', 'acc.p')}))"
    seen = f"aggregate(regexp_extract_all({run}, '.{{1,{BLOCK}}}', 0), named_struct('p', 0, 'seen', cast(array() AS array<int>)), (acc, block) -> {step}, acc -> array_remove(acc.seen, 0))"
    return f"aggregate({seen}, named_struct('t', 0.0D, 'n', 0), (s, code) -> named_struct('t', s.t + element_at({table}, code), 'n', s.n + 1))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan_up(values: str, merge: str) -> str:
    """Running merge of an array, in terms of x (an element) and y (one before it): doubling steps, n log n altogether."""
    y = "acc[i - shiftleft(1, r)]"
    step = f"transform(acc, (x, i) -> CASE WHEN i < shiftleft(1, r) THEN x ELSE {merge.replace('y', y)} END)"
    return f"aggregate(sequence(0, 30), {values}, (acc, r) -> CASE WHEN shiftleft(1, r) >= size(acc) THEN acc ELSE {step} END)"


def _placed(df: DataFrame, out: str, kind: int, fields: str, keep: str) -> DataFrame:
    """Adds the spans of raw_.m (with keep true of match number i); a match ends where all gaps and matches up to it end."""
    lengths = "transform(raw_.m, (x, i) -> length(raw_.g[i]) + length(x))"
    df = df.withColumn("ends_", F.expr(f"CASE WHEN size(raw_.m) > 0 THEN {_scan_up(lengths, 'x + y')} END"))
    kept = f"filter(sequence(0, size(ends_) - 1), i -> {keep})"
    span = fields.format(s="ends_[i] - length(raw_.m[i])", kind=kind, e="ends_[i]", m="raw_.m[i]")
    return df.withColumn(out, F.expr(f"CASE WHEN ends_ IS NULL THEN cast(array() AS {_KINDS_OF[fields]}) ELSE transform({kept}, i -> {span}) END")).drop("raw_", "ends_")


_SPAN = "named_struct('s', {s}, 'kind', {kind}, 'e', {e})"
_WITH_MATCH = "named_struct('s', {s}, 'kind', {kind}, 'e', {e}, 'm', {m})"
_KINDS_OF = {_SPAN: "array<struct<s:int,kind:int,e:int>>", _WITH_MATCH: "array<struct<s:int,kind:int,e:int,m:string>>"}


def _cut(a: str, b: str) -> str:
    """Characters a to b of the text, out of blocks_, so that a piece costs its own length and not its place."""
    i, j = f"({a}) div {BLOCK}", f"({b}) div {BLOCK}"
    return (
        f"CASE WHEN {b} <= {a} THEN '' WHEN {i} = {j} THEN substring(get(blocks_, cast({i} AS int)), ({a}) % {BLOCK} + 1, {b} - ({a}))"
        f" ELSE concat(substring(get(blocks_, cast({i} AS int)), ({a}) % {BLOCK} + 1), array_join(slice(blocks_, cast({i} AS int) + 2, cast({j} - {i} AS int) - 1), ''),"
        f" substring(coalesce(get(blocks_, cast({j} AS int)), ''), 1, ({b}) % {BLOCK})) END"
    )


def _rebuilt(df: DataFrame, out: str, spans: str, piece: str) -> DataFrame:
    """Adds the text with its spans rewritten (null without spans). piece: what stands for span number k, in terms of its
    start s, the greatest end before it (before), and the greatest end up to it (until)."""
    df = df.withColumn("blocks_", F.expr(f"CASE WHEN size({spans}) > 0 THEN regexp_extract_all(text_, '(?s).{{1,{BLOCK}}}', 0) END"))
    ends = f"transform({spans}, x -> x.e)"
    df = df.withColumn("until_", F.expr(f"CASE WHEN size({spans}) > 0 THEN {_scan_up(ends, 'greatest(x, y)')} END"))
    before = "CASE WHEN k = 0 THEN 0 ELSE until_[k - 1] END"
    parts = f"transform(sequence(0, size(until_) - 1), k -> {piece.format(s=f'{spans}[k].s', before=f'({before})', until='until_[k]')})"
    rest = _cut("element_at(until_, -1)", "length(text_)")
    return df.withColumn(out, F.expr(f"CASE WHEN until_ IS NOT NULL THEN concat(array_join({parts}, ''), {rest}) END")).drop("blocks_", "until_")


def _rule_spans(df: DataFrame) -> DataFrame:
    """Adds spans_assign, spans_access, spans_hex over column text_."""
    for number, (kind, pattern, group, least) in enumerate(RULES):
        p = _quoted(LONG.get(kind, pattern))
        needed = f"contains(text_, 'AKIA') AND text_ rlike {_quoted(NEEDED[kind])}" if kind == "access" else f"text_ rlike {_quoted(NEEDED[kind])}"
        df = df.withColumn("raw_", F.expr(f"CASE WHEN {needed} THEN named_struct('m', regexp_extract_all(text_, {p}, 0), 'v', regexp_extract_all(text_, {p}, {group}), 'g', split(text_, {p}, -1)) END"))
        df = _placed(df, f"spans_{kind}", number, _SPAN, f"length(raw_.v[i]) >= {least}")
    return df


def _masked(df: DataFrame) -> DataFrame:
    """Adds base_, all rule spans in order, and masked_: the text with them blanked, so that what is left of a run that a rule covers in part is a run of its own."""
    df = df.withColumn("base_", F.expr("array_sort(concat(spans_assign, spans_access, spans_hex))"))
    blank = "concat(" + _cut("{before}", "{s}") + ", repeat(' ', {until} - greatest({before}, {s})))"
    return _rebuilt(df, "masked_", "base_", blank).withColumn("masked_", F.coalesce("masked_", "text_"))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    names = "array(" + ",".join(f"'{x}'" for x in KINDS) + ")"
    joined = lambda c: f"array_join(transform({c}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')"
    return find_spans(rows, model).selectExpr(
        "doc_id", "cast(size(spans_assign) AS bigint) AS n_assign", "cast(size(spans_access) AS bigint) AS n_access", "cast(size(spans_hex) AS bigint) AS n_hex",
        "cast(size(random_) AS bigint) AS n_random", f"sha2({joined('base_')}, 256) AS base_sha256", f"{joined('all_')} AS spans",
    )


def find_spans(df: DataFrame, model: Model) -> DataFrame:
    """Adds arrays of spans over column text_: spans_assign, spans_access, spans_hex, base_ (these in order), random_ and all_."""
    df = _masked(_rule_spans(df))
    p = _quoted(CANDIDATE)
    df = df.withColumn("raw_", F.expr(f"CASE WHEN masked_ rlike {p} THEN named_struct('m', regexp_extract_all(masked_, {p}, 0), 'g', split(masked_, {p}, -1)) END")).drop("masked_")
    df = _placed(df, "cand_", len(RULES), _WITH_MATCH, "true")
    judged = f"filter(transform(cand_, c -> named_struct('s', c.s, 'kind', c.kind, 'e', c.e, 'j', {_judged('c.m', model.ratios)})), c -> c.j.n >= {DIFFERENT} AND c.j.t >= greatest({model.evidence}D, {model.margin}D * c.j.n))"
    df = df.withColumn("random_", F.expr(f"transform({judged}, c -> named_struct('s', c.s, 'kind', c.kind, 'e', c.e))")).drop("cand_")
    return df.withColumn("all_", F.expr("CASE WHEN size(random_) = 0 THEN base_ ELSE array_sort(concat(base_, random_)) END"))


def redact(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[SECRET]", length_col: str = "n_chars") -> DataFrame:
    """docs with every span in its text replaced by the mark, and the length column brought up to date where there is one.

    A null text stays null. The columns of docs may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"))
    piece = "CASE WHEN {s} >= {before} THEN concat(" + _cut("{before}", "{s}") + f", {_quoted(mark)}) ELSE '' END"
    found = _rebuilt(find_spans(rows, model), "clean_", "all_", piece)
    field = lambda c: F.col("row").getField(c)
    new = {text_col: F.coalesce("clean_", field(text_col)), length_col: F.when(F.col("clean_").isNull(), field(length_col)).otherwise(F.length("clean_"))}
    return found.select(*((new[c] if c in new else field(c)).alias(c) for c in docs.columns))
