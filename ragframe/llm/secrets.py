"""Secret scan with built-in functions only: fixed patterns plus character Markov models.

Three patterns give the base spans: assignments to secret names, access keys and long hex strings.
Beyond them, runs of token characters are scored by two first-order character Markov models, one of
random strings and one of ordinary identifiers, trained from labelled samples; a run whose mean
log-likelihood ratio for each transition reaches a threshold is a span of kind "markov".  In any other
run the stretches that look random are such spans, so that names and paths around a secret don't hide it.
Runs are sought in the text with its base spans blanked, so no such span overlaps one.  The models become
one table of 128 x 128 ratios, a constant of the plan; a pair of characters that neither sample holds is
no evidence.  Ordinary identifiers are composed from the words of WORDS and from the words of the scanned
documents themselves: all words that CORPUS_LEAST of all texts hold, each as often as texts hold it.  A
text that is there twice counts twice.

Positions are code points, the end exclusive.  They come from `split`, which gives the text between the
matches of a pattern, beside `regexp_extract_all`, which gives the matches themselves.  Running sums are
taken in blocks and texts are cut through short pieces, so that time grows with a text's length and the
number of its spans, not with their product.

Defined results.  Null text counts as empty; a text without spans gives empty strings, zero counts and
the SHA-256 of the empty string.  Every row of the input gives one row, repeated ids too; an empty table
gives an empty result.  `scan` keeps doc_id and its own columns only; `redact` keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns and the least length of a match (of group 2, for assignments).
ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Runs that the models judge: token characters, this many at least.
MIN_RUN = 20
RUN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Mean log-likelihood ratio, in nats for each transition, from which a run is a secret.
THRESHOLD = 0.6
#: A stretch of a run: this many characters at least, with the evidence of the least run; it ends where the
#: summed ratio has fallen by this much, in nats, or to nothing.
MIN_STRETCH, DROP = 16, 8.0
#: Different characters that a run or a stretch must have to be a secret: a line of marks isn't one.
MIN_DISTINCT = 6
SMOOTHING = 0.5
SAMPLES = 4000
#: The texts that must hold a word of the corpus, and the words that `corpus_words` shows.
CORPUS_LEAST, CORPUS_WORDS = 3, 2000
#: Forms of ordinary identifiers: w, T and U are a word in lower case, with a capital and in capitals, 0 is a number.
FORMS, NUMBERS = ("w_w_w", "wTT", "www", "w-w-0", "U_U_U", "w/w/w", "Tw=0", "w--w__w"), 2100
#: Elements of a block of running sums, characters of a piece of text, and how far a stretch is widened.
BLOCK, PIECE, WIDEN = 64, 512, 256

#: Ordinary words of code, prose and paths, from which labelled identifiers are composed.
WORDS = """account action address admin alert array article async average backup balance batch before binary block body branch
browser buffer button cache callback center change channel check child class client cloud column command comment commit common
compile config connect content context control cookie count create current customer database default delete design detail device
digest display document domain driver element email enable engine entry error event example export factory feature field file
filter final folder format function gateway generate global group handler header height history image import index information
input instance integer interface internal invoice item journal kernel label language layout library license limit link list local
location machine manager market master matrix measure member memory message method minimum model module monitor network notification
number object operation option order package page parameter parent password payment people picture place player policy position
president private process product profile program project property protocol provider public quality query question random record
reference region register release remote report request resource response result return review schedule schema science screen
search secret section security sequence server service session setting signature simple software source standard state status
aujourd enfant toujours pendant ensemble maison gouvernement entreprise nicht zwischen gesellschaft entwicklung wirtschaft
geschichte siempre gobierno desarrollo empresa personas tiempo nuestra""".split()


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the words of three to sixteen ASCII letters, in lower case, and how many of all texts hold them."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?<![\\p{L}\\p{N}_])[a-z]{3,16}(?![\\p{L}\\p{N}_])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= CORPUS_LEAST)


def corpus_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The words that most texts hold, to be looked at; the models take all of `corpus_counts`."""
    return [r.word for r in corpus_counts(docs, text).orderBy(F.desc("n"), "word").limit(CORPUS_WORDS).collect()]


def corpus_pairs(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """The mean number of each pair of characters, as in `train`, in an identifier of the corpus's words; empty without words.

    Each word counts as often as texts hold it, in every form and at every place alike.  Spark sums the
    letters' pairs over all words; at most 2 x 27 x 27 sums reach the driver, which puts the forms together.
    """
    edged = F.concat(F.array(F.lit(0)), F.transform(F.split("word", ""), F.ascii), F.array(F.lit(0)))
    pairs = corpus_counts(docs, text).select("n", edged.alias("codes")).select("n", F.explode(F.expr("transform(sequence(1, size(codes) - 1), i -> struct(i = 2 as head, codes[i - 1] as a, codes[i] as b))")).alias("p"))
    sums = sorted((r.head, r.a, r.b, r.n) for r in pairs.groupBy("p.head", "p.a", "p.b").agg(F.sum("n").alias("n")).collect())
    size = sum(n for _, a, _, n in sums if not a)
    if not size:
        return {}
    lower, upper = lambda x, head: x, lambda x, head: x - 32
    capital = lambda x, head: x - 32 if head else x
    parts = {}  # of each kind of part: pairs within it, first and last characters, with their shares
    for kind, case in (("w", lower), ("T", capital), ("U", upper)):
        within: dict[int, float] = {}
        for head, a, b, n in sums:
            if a and b:
                pair = case(a, head) * 128 + case(b, False)
                within[pair] = within.get(pair, 0.0) + n / size
        parts[kind] = within, {case(b, True): n / size for _, a, b, n in sums if not a}, {case(a, False): n / size for _, a, b, n in sums if not b}
    within, firsts, lasts = parts["0"] = {}, {}, {}
    for digits in (str(i).encode() for i in range(NUMBERS)):
        for own, key in [(firsts, digits[0]), (lasts, digits[-1]), *((within, x * 128 + y) for x, y in zip(digits, digits[1:], strict=False))]:
            own[key] = own.get(key, 0.0) + 1 / NUMBERS
    mean: dict[int, float] = {}
    for form in FORMS:
        chain = [parts.get(x, ({}, {ord(x): 1.0}, {ord(x): 1.0})) for x in form]
        joints = [(x * 128 + y, m * n) for (_, _, lasts), (_, firsts, _) in zip(chain, chain[1:], strict=False) for x, m in lasts.items() for y, n in firsts.items()]
        for pair, n in [*(item for within, _, _ in chain for item in within.items()), *joints]:
            mean[pair] = mean.get(pair, 0.0) + n / len(FORMS)
    return mean


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled samples (token, label): 1 for random strings, 0 for ordinary identifiers of WORDS; made by rule, n of each."""
    ids = spark.range(n).select(F.col("id").cast("string").alias("i"), "id")
    seed = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), "i"), 512))
    plain = F.regexp_replace(F.base64(seed("a")), "[\\r\\n]", "")
    text = [F.substring(plain, 1, 40), F.substring(F.regexp_replace(plain, "[+/=]", ""), 1, 36), F.sha2(F.concat(F.lit("b"), "i"), 256), F.upper(F.substring(F.regexp_replace(plain, "[+/=a-z]", ""), 1, 30)), F.substring(F.translate(plain, "+/", "-_"), 1, 43), F.lower(F.substring(F.regexp_replace(plain, "[+/=]", ""), 1, 32))]
    random = ids.select(F.element_at(F.array(*text), (F.col("id") % len(text) + 1).cast("int")).alias("token"), F.lit(1).alias("label"))
    known = F.split(F.lit(" ".join(WORDS)), " ")
    drawn = lambda salt, size: F.pmod(F.crc32(F.concat(F.lit(salt), "i").cast("binary")), F.lit(size))
    chosen = ids.select("*", *(F.element_at(known, (drawn(x, len(WORDS)) + 1).cast("int")).alias(x) for x in "abc"), drawn("d", NUMBERS).cast("string").alias("d"))

    def named(form: str) -> Column:
        names = iter("abc")
        part = {"w": lambda: F.col(next(names)), "T": lambda: F.initcap(next(names)), "U": lambda: F.upper(next(names)), "0": lambda: F.col("d")}
        return F.concat(*(part[x]() if x in part else F.lit(x) for x in form))

    return random.unionByName(chosen.select(F.element_at(F.array(*map(named, FORMS)), (F.col("id") % len(FORMS) + 1).cast("int")).alias("token"), F.lit(0).alias("label")))


def train(labelled: DataFrame, corpus: dict[int, float] | None = None) -> list[float]:
    """The table of log-likelihood ratios: at 128 * ascii(a) + ascii(b), ln P(b|a, random) - ln P(b|a, ordinary).

    Counts of pairs are taken by Spark; at most 2 x 128 x 128 of them reach the driver.  Where there is a
    `corpus` (see `corpus_pairs`), half of the ordinary identifiers are its own: as many as SAMPLES / 2.
    """
    codes = F.transform(F.split("token", ""), F.ascii)
    pairs = labelled.filter("length(token) > 1").select("label", codes.alias("codes")).select("label", F.explode(F.expr("transform(sequence(1, size(codes) - 1), i -> codes[i - 1] * 128 + codes[i])")).alias("pair"))
    seen = {(r.label, r.pair): r.n for r in pairs.filter("pair between 0 and 16383").groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if corpus:
        ordinary = {pair: seen.get((0, pair), 0) / 2 + SAMPLES / 2 * corpus.get(pair, 0.0) for pair in sorted({*corpus, *(p for label, p in seen if not label)})}
        seen = {key: n for key, n in seen.items() if key[0]} | {(0, pair): n for pair, n in ordinary.items()}
    total = dict.fromkeys([(label, a) for label in (0, 1) for a in range(128)], 0)
    for (label, pair), n in seen.items():
        total[label, pair >> 7] += n
    log = lambda label, pair: math.log((seen.get((label, pair), 0) + SMOOTHING) / (total[label, pair >> 7] + SMOOTHING * len(ALPHABET)))
    own = {ord(x) for x in ALPHABET}
    known = {pair for _, pair in seen}
    return [round(log(1, p) - log(0, p), 3) if p in known and p >> 7 in own and p & 127 in own else 0.0 for p in range(128 * 128)]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(xs: Column, combine) -> Column:
    """The running sums (or maxima) of an array of integers.

    An array that grows by one element at a time takes quadratic time, so it is done within blocks, over
    the blocks' last elements, and put together.
    """
    none = F.expr("cast(array() as array<int>)")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    more = lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(last(acc), x), x)))

    def run(v: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(v, i * BLOCK + 1, F.lit(BLOCK)), none, more))
        before = lambda b: F.aggregate(b, F.expr("array(cast(null as int))"), lambda acc, x: more(acc, last(x)))
        joined = lambda b: F.flatten(F.zip_with(b, F.slice(before(b), F.lit(1), F.size(b)), lambda x, s: F.transform(x, lambda y: F.coalesce(combine(s, y), y))))
        return F.when(F.size(v) > 0, _let(blocks, joined)).otherwise(none)

    return _let(xs, run)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).otherwise(F.greatest(a, b))


def _spans(text: Column, pattern: str, kind: int, quick: str | None = None, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, ord, end, hit>> of a pattern's matches whose `group` has `least` characters.

    quick: a pattern without which there is none, tried first.
    """
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.zip_with(F.arrays_zip(hits.alias("hit"), sized.alias("own")), F.slice(parts, 1, F.size(hits)), lambda h, p: F.struct(F.length(p).alias("gap"), h.hit.alias("hit"), F.length(h.hit).alias("size"), F.length(h.own).alias("own")))

    def placed(v: Column) -> Column:
        ends = _running(F.transform(v, lambda x: x.gap + x.size), _plus)
        return F.filter(F.zip_with(v, ends, lambda x, end: F.struct((end - x.size).alias("start"), F.lit(kind).alias("ord"), end.alias("end"), x.hit.alias("hit"), x.own.alias("own"))), lambda s: s.own >= least)

    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,hit:string,own:int>>)")
    return F.when(text.rlike(quick or pattern), _let(rows, placed)).otherwise(none)


def _rewritten(text: Column, spans: Column, mark) -> Column:
    """text with mark(span, end of the spans before it) in place of each span; spans are sorted and may overlap."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def put(v: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(v.pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, some.substr(start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

        def parts(reached: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reached, F.lit(1), F.size(reached) - 1))
            return F.zip_with(v.spans, before, lambda s, at: F.concat(cut(at, s.start), mark(s, at)))

        return _let(_running(F.transform(v.spans, lambda s: s.end), _most), lambda reached: F.concat(F.array_join(parts(reached), ""), cut(F.element_at(reached, -1), F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(pieces.alias("pieces"), spans.alias("spans")), put))


def ratio(token: Column, table: Column) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    codes = F.transform(F.split(token, ""), F.ascii)
    scored = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(c.alias("last"), (acc.sum + F.when(acc.last >= 0, F.get(table, acc.last * 128 + c)).otherwise(0.0)).alias("sum")), lambda acc: acc.sum)
    return scored / F.greatest(F.length(token) - 1, F.lit(1))


def stretches(token: Column, table: Column, threshold: float = THRESHOLD) -> Column:
    """array<struct<start, end>>: the parts of a token that look random, out to the next separator on both sides (WIDEN characters at most)."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def closed(acc: Column) -> Column:
        size = acc.end - acc.start
        enough = (acc.best >= threshold * (MIN_RUN - 1)) & (size >= MIN_STRETCH) & (acc.best >= threshold * (size - 1))
        return F.when(enough, F.concat(acc.out, F.array(F.struct(acc.start.alias("start"), acc.end.alias("end"))))).otherwise(acc.out)

    def step(acc: Column, c: Column) -> Column:
        total = acc.sum + F.when(acc.last >= 0, F.get(table, acc.last * 128 + c)).otherwise(0.0)
        cut, after = (total <= 0) | (total < acc.best - DROP), acc.at + 1
        kept = lambda fresh, old: F.when(cut, fresh).otherwise(old)
        end = F.when(cut | (total > acc.best), after).otherwise(acc.end)
        return F.struct(after.alias("at"), c.alias("last"), kept(F.lit(0.0), total).alias("sum"), kept(F.lit(0.0), F.greatest(acc.best, total)).alias("best"), kept(acc.at, acc.start).alias("start"), end.alias("end"), kept(closed(acc), acc.out).alias("out"))

    def widened(s: Column) -> Column:
        inside = lambda at: token.substr(at, F.lit(1)).rlike("[A-Za-z0-9]")
        left = F.least(s.start, F.lit(WIDEN))
        before = F.length(F.regexp_extract(token.substr(s.start - left + 1, left), "(?<![A-Za-z0-9])[A-Za-z0-9]*$", 0))
        after = F.length(F.regexp_extract(token.substr(s.end + 1, F.lit(WIDEN)), "^[A-Za-z0-9]*", 0))
        return F.struct((s.start - F.when(inside(s.start + 1), before).otherwise(0)).alias("start"), (s.end + F.when(inside(s.end), after).otherwise(0)).alias("end"))

    def merged(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.least(last.start, s.start).alias("start"), F.greatest(last.end, s.end).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s.start <= last.end, joined).otherwise(F.concat(acc, F.array(s)))

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out"))
    found = F.aggregate(F.transform(F.split(token, ""), F.ascii), start, step, closed)
    varied = F.filter(found, lambda s: F.size(F.array_distinct(F.split(token.substr(s.start + 1, F.least(s.end - s.start, F.lit(WIDEN))), ""))) >= MIN_DISTINCT)
    return F.aggregate(F.transform(varied, widened), none, merged)


def with_spans(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, labelled: DataFrame | None = None) -> DataFrame:
    """docs with __base and __spans: sorted arrays of struct<start, ord, end>, ord an index of KINDS."""
    ratios = train(samples(docs.sparkSession), corpus_pairs(docs, text)) if labelled is None else train(labelled)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a constant
    plain = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s.start, s.ord, s.end)))
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(_spans(whole, ASSIGN, 0, f"[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{{{MIN_ASSIGN}}}", group=1, least=MIN_ASSIGN), _spans(whole, ACCESS, 1, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4}}}", least=MIN_ACCESS), _spans(whole, HEX, 2, f"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}", least=MIN_HEX))

    def judged(run: Column, table: Column) -> Column:
        random = (ratio(run.hit, table) >= threshold) & (F.size(F.array_distinct(F.split(run.hit, ""))) >= MIN_DISTINCT)
        span = lambda a, b: F.struct((run.start + a).alias("start"), run.ord.alias("ord"), (run.start + b).alias("end"))
        return F.when(random, F.array(span(F.lit(0), F.length(run.hit)))).otherwise(F.transform(stretches(run.hit, table, threshold), lambda s: span(s.start, s.end)))

    docs = docs.withColumn("__base", plain(base))
    blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s.end - F.greatest(s.start, at)))
    docs = docs.withColumn("__masked", _rewritten(whole, F.col("__base"), blank))
    # the plan names the table once: named in each lambda, its text alone would fill the driver's memory
    runs = F.flatten(_let(F.struct(_spans(F.col("__masked"), RUN, 3).alias("runs"), table.alias("table")), lambda v: F.transform(v.runs, lambda run: judged(run, v.table))))
    docs = docs.withColumn("__runs", runs)
    return docs.withColumn("__spans", F.when(F.size("__runs") == 0, F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__runs")))).drop("__runs", "__masked")


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.ord), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    found = with_spans(docs.select("doc_id", "text"), threshold=threshold)
    count = lambda k: F.size(F.filter("__spans", lambda s: s.ord == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(_joined("__base").cast("binary"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of text replaced by a mark (overlapping spans by one), n_chars set anew where there is one.

    A document without spans is unchanged; a null text stays null.
    """
    # a row as one column, so that its names can't clash
    found = with_spans(docs.select("text", F.struct(*docs.columns).alias("row")), threshold=threshold)
    text, some = F.col("text"), F.size("__spans") > 0
    fresh = lambda s, at: F.when(s.start >= at, F.lit(mark)).otherwise(F.lit(""))
    clean = found.select("row", F.when(some, _rewritten(text, F.col("__spans"), fresh)).otherwise(text).alias("text"), some.alias("some"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("some"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return clean.select(row.alias("row")).select("row.*")
