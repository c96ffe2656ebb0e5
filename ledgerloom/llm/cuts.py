"""Texts cut off by field limits or in transfer."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.prefix import prefix_sums
from ledgerloom.operators.joins import spread
from ledgerloom.session import Workspace

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: A token and what stands between it and the next one.
GAPPED = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)([\W_]*)")
CLOSED = re.compile(r"[.!?。؟][\"'”’»)\]]*$")
#: A mark of omission, or a note in brackets on the last line of the text proper.
MARKER = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.)\]| \[[^\]\n]{2,40}\])$")
#: Lengths so near, in characters or bytes, give the hazard that a length is held against.
NEAR = 50
#: The highest tenth of the lengths near by tells nothing about the spread of the others: other limits may stand among them.
TRIM = 0.1
#: A mark of omission stands at most so many characters before the limit that made it necessary.
WORD_ROOM = 18
#: Letters of a prefix that words are joined by.
KEY = 48
FEATURES = (
    "doc_id bigint, source string, hash string, chars int, bytes int, closed boolean, marker boolean, torn boolean, word string, before string, plain boolean, lower boolean, opening string, closing string, mark string"
)


def torn_table(text: str) -> bool:
    """Lines of a table, of which the last has fewer cells, or a last number with fewer decimals than all others of its column."""
    lines = text.rstrip("\r\n").split("\n")
    if len(lines) < 3:
        return False
    for sep in ";\t|,":
        cells = lines[0].count(sep)
        if cells >= 2 and all(x.count(sep) == cells for x in lines[:-1]):
            if lines[-1].count(sep) < cells:
                return True
            ends = [re.search(r"\.(\d+)$", x.strip()) for x in lines[1:-1]]
            digits = {len(m.group(1)) for m in ends if m}
            last = re.search(r"\.(\d+)$", lines[-1].strip())
            return bool(all(ends) and len(digits) == 1 and (not last or len(last.group(1)) < min(digits)))
    return False


def shape(s: str) -> str:
    return re.sub(r"\d+", "9", s)


def short(s: str) -> str:
    """Itself, or, of a long one, its hash: enough to tell whether two are equal."""
    return s if len(s) <= 200 else hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()


def ending(text: str) -> tuple:
    """The features of FEATURES from ``closed`` on."""
    s = text.rstrip()
    room = 400
    while True:
        # as much of the end as holds the last two tokens whole
        tail = s[-room:]
        toks = list(TOKEN.finditer(tail))
        if room >= len(s) or (len(toks) > 2 or (len(toks) == 2 and toks[0].start() > 1)):
            break
        room *= 8
    at_end = bool(toks) and toks[-1].end() == len(tail)
    word = toks[-1].group() if at_end else ""
    before = toks[-2].group().lower() if at_end and len(toks) > 1 else ""
    opening = shape(re.match(r"[^\w]*(?:\d[\d\W]*)?", s).group()) if s else ""
    closing = short(shape(s[s.rfind("\n") + 1 :]))
    omission = MARKER.search(s)
    marker = bool(omission)
    closed = bool(CLOSED.search(s)) or s.endswith(("]", ")", "”", "»", '"')) or not s
    return (
        closed and not marker, marker, torn_table(s) or s.endswith((",", ";", "(", "&", "-")), word.lower(), before,
        bool(word) and word.isalpha(), word[:1].islower(), short(opening) if len(opening) >= 8 else "", closing, shape(omission.group().strip().lower()) if omission else "",
    )


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for b in batches:
        rows = [(d, s, h, len(t), len(t.encode("utf-8", "surrogatepass")), *ending(t)) for d, s, h, t in zip(b["doc_id"], b["source"], b["hash"], b["text"])]
        yield pd.DataFrame(rows, columns=names)


def _bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(before, word, n, ends): words that something follows in their text, and how often a sentence or paragraph ends with them."""
    for b in batches:
        n, ends = Counter(), Counter()
        for text in b["text"]:
            found = GAPPED.findall(text.lower())
            pairs = list(zip(["", *[w for w, _ in found]], [w for w, _ in found[:-1]]))
            n.update(pairs)
            ends.update([p for p, (_, gap) in zip(pairs, found) if gap[0] in ".!?" or "\n\n" in gap])
        yield pd.DataFrame([(p, w, c, ends[p, w]) for (p, w), c in n.items()], columns=["before", "word", "n", "ends"])


def log_tail(n: int, mean: float, extra: float = 0.0) -> float:
    """log of the probability of ``n`` or more where ``mean`` are expected: Poisson, or with variance mean + extra * mean^2 negative binomial."""
    if n <= mean:
        return 0.0
    r = 1 / extra if extra > 1e-6 else math.inf
    if r < math.inf:
        p = mean / (mean + r)
        t = math.lgamma(n + r) - math.lgamma(r) - math.lgamma(n + 1) + n * math.log(p) - r * math.log1p(mean / r)
        step = lambda k: p * (k + r) / (k + 1)
    else:
        p = 0.0
        t = -mean + n * math.log(mean) - math.lgamma(n + 1)
        step = lambda k: mean / (k + 1)
    total, term, k = 0.0, 1.0, n
    while term > 1e-12 and k < n + 400:
        total, term, k = total + term, term * step(k), k + 1
    # what is left falls at least as fast as a geometric series
    return min(0.0, t + math.log(total + term / (1 - max(p, step(k)))))


def excess(beside: list[int], length: int) -> float:
    """Variance above the mean, as a share of the squared mean, of the counts of texts of the lengths near by, of which the TRIM highest are left out."""
    width = NEAR + min(NEAR, max(0, length - 1))
    counts = sorted(beside)[: max(0, len(beside) - int(TRIM * width))]
    size = width - int(TRIM * width)
    mean = sum(counts) / size
    return max(0.0, (sum(c * c for c in counts) - size * mean * mean) / (size - 1) - mean) / mean**2 if mean else 0.0


def _tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """log_tail of ``n`` where ``mean`` are expected and the lengths near by have the counts ``beside``."""
    for b in batches:
        logp = [log_tail(int(n), float(m), excess(list(x), int(i))) for n, m, x, i in zip(b["n"], b["mean"], b["beside"], b["length"])]
        yield b.drop(columns="beside").assign(logp=logp)


def significant_lengths(work: Workspace, lengths: DataFrame, level: float = 1e-3) -> DataFrame:
    """source, unit, length of the lengths at which more texts end than the hazards near by let expect.

    ``lengths``: source, unit, length, n (distinct texts of that length). The hazard of a length is the share of the texts that reach it
    that end there. Its expectation is the mean hazard of the NEAR lengths before and after it, for texts that
    reach it. Lengths of texts made of parts of one size come in broad waves, so the number is held against a negative
    binomial distribution as wide as the counts near by (Poisson where they are not wider); the false-discovery rate over all lengths is held at ``level`` (Benjamini and Hochberg), with ranks from distributed prefix sums.
    Windows run over the distinct lengths of a source, which are as many as its longest text has characters at most.
    """
    w = W.partitionBy("source", "unit").orderBy("length")
    near = F.sum("n").over(w.rangeBetween(-NEAR, NEAR)) - F.col("n")
    # a running sum and the whole: linear in the lengths
    ended = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1))
    reach = F.sum("n").over(W.partitionBy("source", "unit")) - F.coalesce(ended, F.lit(0))
    # hazards near by: what ends there, among what reaches the middle of each side
    before = F.sum("n").over(w.rangeBetween(-NEAR, -1))
    hazards = lengths.select(
        "source", "unit", "length", "n", F.coalesce(near, F.lit(0)).alias("near"), reach.alias("reach"), F.coalesce(before, F.lit(0)).alias("before"), F.concat(F.collect_list("n").over(w.rangeBetween(-NEAR, -1)), F.collect_list("n").over(w.rangeBetween(1, NEAR))).alias("beside")
    )
    # texts at risk over the neighbouring lengths: those that reach this one, those that end before it in part, less those that end after it in part
    risk = 2 * NEAR * (F.col("reach") + (F.col("before") - (F.col("near") - F.col("before"))) / 4)
    hazard = (F.col("near") + 1) / F.greatest(risk, F.lit(1.0))
    tested = hazards.withColumn("mean", F.least(F.col("reach").cast("double"), F.greatest(hazard * F.col("reach"), F.lit(1e-6)))).select("source", "unit", "length", "n", "mean", "beside")
    tested, m = work.write(tested.mapInPandas(_tail, "source string, unit string, length int, n bigint, mean double, logp double"), "tested", tests=F.count(F.lit(1)))
    ranked = prefix_sums(work, tested.withColumn("all", F.lit(1)).withColumn("one", F.lit(1).cast("bigint")), ["all"], ["logp", "source", "unit", "length"], "one", "rank")
    ranked = work.table(ranked, "ranked")
    cut = ranked.where(F.col("logp") <= F.log(F.lit(level) * F.col("rank") / F.lit(max(1, m["tests"])))).agg(F.max("logp").alias("cut")).first().cut
    return ranked.where(F.col("logp") <= cut if cut is not None else F.lit(False)).select("source", "unit", "length")


def _due(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source, mark of the marks that stand before limits at least twice as often as other endings, and mostly so or more often than chance gives."""
    for b in batches:
        due = [z >= 2 * n * p and (2 * z >= n or log_tail(int(z), max(n * p, 1e-6)) <= math.log(1e-3)) for n, z, p in zip(b["n"], b["z"], b["chance"])]
        yield b.loc[due, ["source", "kind"]]


def marked_below(work: Workspace, texts: DataFrame, at: DataFrame, below: DataFrame) -> DataFrame:
    """hash, reason, opening, closing of the texts with a mark of omission that the room before a limit made necessary.

    ``at``: the texts that stand at a limit; ``below``: those in the WORD_ROOM before one, with its source ``s``. Each mark of a source is judged by itself: by
    the share of its texts that stand below a limit, against that of the unmarked texts. Notes that occur once are judged together.
    A text of unknown source takes its mark's verdict among such texts, or in the source of the limit.
    """
    here = lambda df: df.select(F.col("source").alias("s0"), F.col("hash").alias("h0")).distinct()
    same = lambda df, x: df.source.eqNullSafe(x.s0) & (df.hash == x.h0)
    there, near = here(at), here(below).withColumn("near", F.lit(1))
    free = texts.join(there, same(texts, there), "left_anti")
    free = work.table(free.join(near, same(free, near), "left").select("source", "hash", "marker", "mark", F.coalesce("near", F.lit(0)).alias("near")), "free")
    single = free.where(r"marker and mark like '[%' and not mark rlike '^.(…|[.]{3})'").groupBy("mark").agg(F.countDistinct("hash").alias("texts")).where("texts = 1").select("mark", F.lit("[]").alias("other"))
    kinds = work.table(free.where("marker").select("mark").distinct().join(single, "mark", "left").select("mark", F.coalesce("other", "mark").alias("kind")), "kinds")
    chance = free.where("not marker").groupBy(F.col("source").alias("s0")).agg(F.avg("near").alias("chance"))
    counts = free.where("marker").join(kinds, "mark").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("z")).where("z > 0")
    counts = counts.join(chance, counts.source.eqNullSafe(chance.s0), "left").select("source", "kind", "n", "z", F.coalesce("chance", F.lit(0.0)).alias("chance"))
    due = work.table(counts.mapInPandas(_due, "source string, kind string"), "due").select(F.col("source").alias("d"), F.col("kind").alias("due"))
    zone = below.where("marker").join(there, same(below, there), "left_anti").join(kinds, "mark")
    return zone.join(due, (zone.kind == due.due) & (zone.source.eqNullSafe(due.d) | (zone.source.isNull() & zone.s.eqNullSafe(due.d))), "left_semi").select("hash", F.lit("limit").alias("reason"), "opening", "closing")


def cut_documents(spark: SparkSession, documents: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, source, reason of the ``documents`` (doc_id bigint, text, source; further columns are ignored) whose text lacks its end.

    A text is cut if one of these holds of it or of a copy of it:
    - limit: it ends open at a length (in characters or bytes) that is significant for its source, or with a mark of omission at one, or just below one if this mark stands there more often than other endings do;
    - table, list: its last line lacks cells that all others have, or it ends in a comma, bracket or hyphen;
    - line: texts that open in the same way (a time stamp, say) nearly all close with one of a few last lines, and it doesn't;
    - word: its last word begins one that follows the word before it elsewhere, or a common one, and is itself hardly
      found there; of names at least two letters have to be missing;
    - sentence: its last word is common and hardly any sentence or paragraph ends with it, nor an open text with its last two words.
    Words are counted over all texts. A text is open if it doesn't end in a full stop, question or exclamation mark, bracket or closing quote.
    Null and empty texts are not cut. A null source is a source of its own, and the limits of all sources hold for it too.
    """
    work = Workspace(spark, "cuts")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.md5("text").alias("hash"), "text")
    docs = spread(docs, "doc_id")
    feats = work.table(docs.mapInPandas(_features, FEATURES), "features")
    # copies of one text say nothing about lengths: each counts once
    texts = work.table(feats.groupBy("source", "hash").agg(*[F.first(c).alias(c) for c in feats.columns if c not in ("doc_id", "source", "hash")]), "texts")
    lengths = texts.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "length")).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    limits = work.table(significant_lengths(work, lengths), "limits")
    opened = texts.where("not closed")
    at, below = [], []
    for unit in ("chars", "bytes"):
        own = limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length"))
        room = own.select("s", F.explode(F.sequence(F.col("length") - WORD_ROOM, F.col("length") - 1)).alias("length")).distinct()
        for stops, kept in ((own, at), (room, below)):
            # a text of unknown source may be of any
            kept.append(texts.join(stops, (texts[unit] == stops.length) & (texts.source.eqNullSafe(stops.s) | texts.source.isNull())).select(*texts.columns, "s"))
    at = work.table(reduce(DataFrame.unionByName, at).select("source", "hash", "closed", "opening", "closing").distinct(), "at")
    below = work.table(reduce(DataFrame.unionByName, below).select("source", "hash", "marker", "mark", "opening", "closing", "s").distinct(), "below")
    found = [at.where("not closed").select("hash", F.lit("limit").alias("reason"), "opening", "closing"), marked_below(work, texts, at, below)]
    # last lines of texts that open alike
    uniform = texts.where("opening <> ''").select("opening", "closing", "hash").distinct()
    shapes = uniform.groupBy("opening", "closing").agg(F.count(F.lit(1)).alias("n"))
    kinds = shapes.groupBy("opening").agg(F.sum("n").alias("all"))
    usual = shapes.join(kinds, "opening").where((F.col("n") >= 0.02 * F.col("all")) & (F.col("n") >= 3) & (F.col("all") >= least)).select("opening", "closing", "n", "all")
    formal = usual.groupBy("opening").agg((F.sum("n") / F.max("all")).alias("share")).where("share >= 0.6").select("opening")
    usual = work.table(usual.select("opening", "closing"), "usual")
    unlike = uniform.join(formal, "opening", "left_semi").join(usual, ["opening", "closing"], "left_anti").select("hash", F.lit("line").alias("reason"), "opening", "closing")
    limit = work.table(reduce(DataFrame.unionByName, found), "at-limit").join(usual, ["opening", "closing"], "left_anti")
    torn = texts.where("torn").select("hash", F.lit("list").alias("reason"), "opening", "closing")
    # last words against the words inside all texts
    grams = docs.select("text").mapInPandas(_bigrams, "before string, word string, n bigint, ends bigint")
    grams = work.table(grams.groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "grams")
    words = work.table(grams.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "words")
    worded = work.table(opened.where("plain and not marker").join(usual, ["opening", "closing"], "left_anti").select("hash", "before", "word", "lower", "opening", "closing"), "worded")
    finals = worded.groupBy("before", "word").agg(F.countDistinct("hash").alias("finals"))
    last = worded.select("before", "word", "lower").distinct().join(finals, ["before", "word"]).join(words.select("word", "n", "ends"), "word", "left")
    last = work.table(last.join(grams.select("before", "word", F.col("n").alias("pair")), ["before", "word"], "left").fillna(0, ["n", "ends", "pair"]), "last")
    mid = (F.col("n") >= least) & (F.col("ends") <= 0.002 * F.col("n")) & (F.col("pair") >= 50 * F.col("finals"))
    sentence = last.where(mid).select("before", "word", F.lit("sentence").alias("reason"))
    # words that the last one begins: joined by their prefixes, of which those beyond KEY letters are told apart after the join
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(KEY))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    heads = lambda df, cols: df.where("length(word) > 1").select(*cols, F.col("word").alias("whole"), F.col("n").alias("whole_n"), F.explode(starts).alias("head"))
    strange = last.withColumn("head", F.substring("word", 1, KEY))
    longer = F.length("whole") - F.length("word")
    begins = F.col("whole").startswith(F.col("word")) & (longer >= F.when(F.col("lower"), 1).otherwise(2))
    follow = grams.where("n >= 2").join(last.select("before").distinct(), "before", "left_semi")
    after = strange.join(heads(follow, ["before"]), ["before", "head"]).where(begins)
    after = after.where(((F.col("n") <= 1) & (F.col("pair") == 0)) | ((F.col("whole_n") >= least) & (F.col("pair") <= 0.01 * F.col("whole_n")))).select("before", "word").distinct()
    common = strange.where(F.col("lower") & (F.length("word") >= 3)).join(heads(words.where(F.col("n") >= least), []).where("length(head) >= 3"), "head").where(begins & (F.col("n") <= 0.02 * F.col("whole_n"))).select("before", "word").distinct()
    broken = after.union(common).distinct().withColumn("reason", F.lit("word"))
    by_word = worded.select("hash", "before", "word", "opening", "closing").join(sentence.unionByName(broken), ["before", "word"]).select("hash", "reason", "opening", "closing")
    cut = reduce(DataFrame.unionByName, [limit, unlike, torn, by_word]).groupBy("hash").agg(F.min("reason").alias("reason"))
    return feats.select("doc_id", "source", "hash").join(cut, "hash").select("doc_id", "source", "reason")
