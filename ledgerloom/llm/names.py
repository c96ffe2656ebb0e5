"""Variant spellings of names: suffix blocking and comparison by longest common subsequence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import group_pairs
from ledgerloom.operators.joins import lookup_join
from ledgerloom.session import Workspace

#: Common short forms of given names in English and German use; some stand for several names.
SHORT_NAMES = """
abby abigail; al albert alan alfred; alex alexander alexandra; andy andrew andreas; angie angela; annie anna anne; art arthur; babs barbara; barb barbara;
becky rebecca; becca rebecca; bella isabella; ben benjamin; benny benjamin; benji benjamin; bernie bernard; bert albert robert; beth elizabeth; betsy elizabeth; betty elizabeth;
bill william; billy william; bob robert; bobby robert; cathy catherine; charlie charles charlotte; chaz charles; chris christopher christine; chuck charles;
cindy cynthia; connie constance; dan daniel; danny daniel; dave david; deb deborah; debbie deborah; dick richard; don donald; dot dorothy; ed edward edwin edgar;
eddie edward; eliza elizabeth; ella eleanor; flo florence; flossie florence; fran frances; frank francis; fred frederick; freddie frederick; freddy frederick;
gabe gabriel; gabby gabriel; gene eugene; geoff geoffrey; gerry gerald; greg gregory; hal harold; hank henry; harry harold henry; hattie henrietta; hetty henrietta; etta henrietta; izzy isabella;
jack john; jake jacob; jamie james; jeff jeffrey; jen jennifer; jenny jennifer; jerry gerald; jim james; jimmy james; jo josephine joanna; joe joseph; joey joseph; jon jonathan; jonny jonathan; johnny john jonathan;
josie josephine; josh joshua; kat katherine; kate katherine; kathy katherine; katie katherine; kit katherine christopher; kitty katherine; ken kenneth; kenny kenneth; larry lawrence; laurie lawrence; len leonard;
lottie charlotte; lou louisa louis; lulu louisa; liz elizabeth; lizzie elizabeth; libby elizabeth; madge margaret; maggie margaret; mags margaret; meg margaret; marge margaret; matt matthew; max maximilian; mick michael; mickey michael; mike michael; molly mary; nat nathaniel nathan; nate nathaniel nathan;
nell eleanor; nick nicholas; nicky nicholas; nico nicholas; ollie oliver; pam pamela; pat patricia patrick; patty patricia; peg margaret; peggy margaret; penny penelope; pete peter; phil philip; polly mary; quin quentin; ray raymond; rich richard; richie richard;
rick richard; ricky richard; rob robert; robbie robert; ron ronald; ros rosalind; sally sarah; sam samuel samantha; sammy samuel; sandy alexander sandra; sandra alexandra; sascha alexander; sepp josef; steve stephen; sue susanna susan; susie susanna susan; suzy susanna; susi susanna;
ted theodore edward; teddy theodore edward; terry terence; theo theodore; tim timothy; tina christina; toby tobias; tom thomas; tommy thomas; tony anthony; tori victoria; tricia patricia; trish patricia; uli ulrich; uschi ursula; ulla ursula; vic victor victoria; vicky victoria; vicki victoria; viv vivian; vince vincent;
vinny vincent; wally walter; wes wesley; will william; willie william; willy william; winnie winifred; freda winifred; xavi xavier; xav xavier; zach zachary; zack zachary; zak zachary
"""
#: Usual abbreviations of trades in firm names.
SHORT_TRADES = """
assoc associates; assocs associates; avn aviation; aviat aviation; brew brewing; cer ceramics; chem chemicals; constr construction; const construction; cons consulting; consult consulting; eng engineering; engrg engineering; engg engineering; fin financial;
hldg holdings; hldgs holdings; ind industries; inds industries; ins insurance; insur insurance; instr instruments; instrs instruments; intl international; lab laboratories; labs laboratories; logis logistics; mfg manufacturing; manuf manufacturing; mgmt management; mgt management; mar marine; natl national;
opt optics; pharm pharmaceuticals; pharma pharmaceuticals; prop properties; props properties; publ publishing; pub publishing; robot robotics; svc services; svcs services; serv services; tech technologies; text textiles; trans transport; transp transport
"""
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame phd md msc ba ma bsc mba esq jr sr ext hon rev ing dipl herr frau mme mlle".split())
LEGAL = frozenset("inc incorporated ltd limited corp corporation co company llc llp lp plc gmbh ag kg ohg ug bv nv sa sas sarl srl spa oy ab as kk pty".split())
LINKS = frozenset("and und et y e u the".split())


def _table(text: str) -> dict[str, frozenset[str]]:
    return {k: frozenset(v) for k, *v in (x.split() for x in text.replace("\n", " ").split(";"))}


NICK, TRADE = _table(SHORT_NAMES), {k: next(iter(v)) for k, v in _table(SHORT_TRADES).items()}
SUFFIX_MIN, SUFFIX_MAX = 4, 10
#: Up to so many distinct names share a block before it is refined; no block is discarded.
BLOCK = 80


MARKS = frozenset(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.combining(c))


def fold(s: str) -> str:
    """Without case and accents."""
    s = unicodedata.normalize("NFKD", s.casefold())
    if not s.isascii():
        for c in MARKS.intersection(s):
            s = s.replace(c, "")
    return s


def person_form(name: str | None) -> str | None:
    """``tokens|initials``: the tokens of two or more letters in sorted order, single letters in their order."""
    if not name:
        return None
    s = re.sub(r"\([^)]*\)?", " ", fold(name))
    if s.count(",") == 1:
        last, first = s.split(",")
        if {w for w in re.findall(r"[^\W_]+", first)} - TITLES:
            s = f"{first} {last}"
    words = [w for w in re.findall(r"[^\W_]+", s.replace("'", "").replace("’", "")) if w not in TITLES]
    words = words or re.findall(r"[^\W_]+", fold(name))
    return f"{' '.join(sorted(w for w in words if len(w) > 1))}|{''.join(w for w in words if len(w) == 1)}" if words else None


def company_form(name: str | None) -> str | None:
    """``tokens|``: the sorted tokens without notes in brackets, articles, links and legal forms; trades in full."""
    if not name:
        return None
    s = re.sub(r"\([^)]*\)?", " ", fold(name))
    s = re.sub(r"\b((?:[^\W_]\.\s?)+[^\W_]\b\.?)", lambda m: re.sub(r"[.\s]", "", m.group(1)) + " ", s).replace("'", "").replace("’", "")
    words = re.findall(r"[^\W_]+", s)
    kept = [TRADE.get(w, w) for w in words if w not in LEGAL and w not in LINKS] or words or re.findall(r"[^\W_]+", fold(name))
    return f"{' '.join(sorted(kept))}|" if kept else None


@lru_cache(1 << 17)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    # a bit for each letter of the shorter one; each letter of the other takes its row of the table in a few operations
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := row & at.get(y, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str, ratio: float = 0.75) -> bool:
    """One slip apart at most: a letter changed, left out, added or two swapped, with a common subsequence of at least ``ratio``."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < 4:
        return False
    if len(set(a) ^ set(b)) > 2:
        return False
    n = lcs(a, b)
    return n >= max(la, lb) - 1 and 2 * n >= ratio * (la + lb)


def given(a: str, b: str) -> bool:
    """Tokens of persons: alike, or one a short form of the other, or both of the same name."""
    return alike(a, b) or bool((NICK.get(a, frozenset()) | {a}) & (NICK.get(b, frozenset()) | {b}))


def _matched(a: list[str], b: list[str], same) -> bool:
    """Each token of the shorter list has its own partner in the other."""
    if len(a) > len(b):
        a, b = b, a
    left = list(b)
    for x in sorted(a, key=len, reverse=True):
        hit = next((y for y in left if y == x), None) or next((y for y in left if same(x, y)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def _run_together(one: str, other: list[str]) -> bool:
    if len(other) > 4:
        return _in_some_order(one, other, "", False)
    joined = ("".join(p[:i]) + ("and" if i else "") + "".join(p[i:]) for p in permutations(other) for i in range(len(p)))
    return any(alike(one, x) for x in joined)


def _in_some_order(one: str, left: list[str], made: str, linked: bool) -> bool:
    """The same for many tokens: orders are given up as soon as what they have made is more than a slip from the beginning of ``one``."""
    if not left:
        return alike(one, made)
    for i, t in enumerate(left):
        for glue in ("", "and") if made and not linked else ("",):
            now = made + glue + t
            if t not in left[:i] and len(now) <= len(one) + 1 and lcs(now, one[: len(now) + 1]) >= len(now) - 1 and _in_some_order(one, left[:i] + left[i + 1 :], now, linked or bool(glue)):
                return True
    return False


def clash(a: str, b: str) -> bool:
    """Middle letters that contradict each other (both forms of two or more full tokens)."""
    (ta, ia), (tb, ib) = a.split("|"), b.split("|")
    return bool(ia and ib and " " in ta and " " in tb and ia != ib)


def same_person(a: str, b: str) -> tuple[int, str]:
    """(2, '') sure; (1, given name) if a form with letters for given names fits a full one; (0, '') no."""
    (xa, ia), (xb, ib) = a.split("|"), b.split("|")
    ta, tb = xa.split(), xb.split()
    if len(ta) > 1 and len(tb) > 1:
        return (2, "") if not clash(a, b) and len(ta) == len(tb) and _matched(ta, tb, given) else (0, "")
    if len(ta) == 1 and len(tb) == 1:
        if not ia and not ib:
            return (2, "") if alike(ta[0], tb[0]) else (0, "")
        short, long = sorted((ia, ib), key=len)
        return (2, "") if short and long.startswith(short) and alike(ta[0], tb[0]) else (0, "")
    if not ta or not tb:
        return (0, "")
    if len(ta) > 1:
        ta, ia, tb, ib = tb, ib, ta, ia
    if not ia:
        return (2, "") if _run_together(ta[0], tb + list(ib)) or _run_together(ta[0], tb) else (0, "")
    if len(tb) != 2:
        return (0, "")
    for k in (0, 1):
        first, last = tb[k], tb[1 - k]
        if alike(ta[0], last) and any(n[0] == ia[0] for n in NICK.get(first, frozenset()) | {first}) and (len(ia) == 1 or not ib or ia[1:] == ib):
            return (1, min(NICK.get(first, {first})))
    return (0, "")


def same_company(a: str, b: str) -> tuple[int, str]:
    ta, tb = a[:-1].split(), b[:-1].split()
    if len(ta) == len(tb):
        return (2, "") if _matched(ta, tb, alike) else (0, "")
    if len(ta) > len(tb):
        ta, tb = tb, ta
    rest_a, rest_b = list(ta), list(tb)
    for x in ta:
        hit = next((y for y in rest_b if y == x), None) or next((y for y in rest_b if alike(x, y)), None)
        if hit:
            rest_a.remove(x), rest_b.remove(hit)
    return (2, "") if len(rest_a) == 1 and _run_together(rest_a[0], rest_b) else (0, "")


@lru_cache(1 << 16)
def suffixes(token: str) -> set[str]:
    """Suffixes of a token, of the token without its last two letters and of its first three and four (a slip may sit in the rest), and of what a short name stands for."""
    out = set()
    for word in {token, *NICK.get(token, ())}:
        out |= {word[-n:] for n in range(SUFFIX_MIN, min(SUFFIX_MAX, len(word)) + 1)} or {word}
        inner = word[:-2]
        out |= {inner[-n:] + "~" for n in range(SUFFIX_MIN, min(SUFFIX_MAX, len(inner)) + 1)} | {word[:4] + "~~", word[:3] + "~~"}
    return out


def without_one(word: str) -> set[str]:
    """The word, and it without any one letter: words one slip apart (see ``alike``) share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


@lru_cache(1 << 16)
def near(token: str) -> set[str]:
    """Keys that tokens share if ``given`` holds of them."""
    return (without_one(token) if len(token) >= 4 else {token}) | NICK.get(token, frozenset())


def fine_keys(kind: str, form: str, suffix: str) -> set[tuple[str, str]]:
    """(role, key) of a form in a block of a suffix, such that any two forms of the block that can match share a key in fitting roles.

    - same, with same: forms of equally many tokens share the number and a key of another token (of the only one, if there is one);
    - ask, with answer: a person of one token and letters meets full names by their first letters, and forms of the same kind.
    Tokens run together have ``joined_keys``.
    """
    text, letters = form.split("|")
    tokens, out = text.split(), set()
    for i, t in enumerate(tokens):
        if suffix not in suffixes(t):
            continue
        others = [x for j, x in enumerate(tokens) if j != i]
        if others or not letters:
            out |= {("same", f"{len(tokens)}|{k}") for x in others or [t] for k in near(x)}
        if kind != "company":
            if len(tokens) == 1 and letters:
                out |= {("ask", "=" + letters[0]), ("answer", "=" + letters[0])}
            elif len(tokens) == 2:
                out |= {("answer", "=" + n[0]) for n in {*others, *NICK.get(others[0], ())}}
    return out


def joined_keys(reps: DataFrame) -> DataFrame:
    """(kind, rep, role, h) by which a token that may be others run together (ask) meets the first or the last of them (answer).

    One slip leaves the first or the last one whole, unless it swaps the letters between them. ``h`` is a hash of the key.
    """
    parts = reps.selectExpr("kind", "rep", "split(split(form, '[|]')[0], ' ') as tokens", "split(form, '[|]')[1] as letters")
    alone = parts.where("kind = 'company' or (size(tokens) = 1 and letters = '')").selectExpr("kind", "rep", "explode(tokens) as t").where("length(t) > 1")
    cuts = alone.selectExpr("kind", "rep", "t", "explode(sequence(1, length(t) - 1)) as i")
    asks = cuts.selectExpr("kind", "rep", "'ask' as role", "explode(array(concat('^', substring(t, 1, i)), concat('$', substring(t, i + 1)), concat('^', substring(t, 1, i - 1), substring(t, i + 1, 1)))) as key")
    held = parts.where("size(tokens) > 1").selectExpr("kind", "rep", "explode(concat(tokens, filter(split(letters, ''), x -> x <> ''))) as t")
    answers = held.selectExpr("kind", "rep", "'answer' as role", "explode(array(concat('^', t), concat('$', t))) as key")
    return asks.unionByName(answers).select("kind", "rep", "role", F.xxhash64(F.lit(""), F.col("key")).alias("h"))


def finer_keys(form: str, suffix: str, key: str) -> set[str]:
    """Keys of a third token for forms of three or more that share a suffix and the ``same`` key of a second."""
    tokens = form.split("|")[0].split()
    first = key.split("|", 1)[1]
    out = set()
    for i, j, k in permutations(range(len(tokens)), 3):
        if suffix in suffixes(tokens[i]) and first in near(tokens[j]):
            out |= {"|".join([str(len(tokens)), *sorted((first, x))]) for x in near(tokens[k])}
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = [(company_form if k == "company" else person_form)(n) for k, n in zip(b["kind"], b["name"])]
        yield b[["kind", "id", "mail"]].assign(form=forms).dropna(subset=["form"])


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, r, f, s) for k, r, f in zip(b["kind"], b["rep"], b["form"]) for s in set().union(*map(suffixes, f.split("|")[0].split()))]
        yield pd.DataFrame(rows, columns=["kind", "rep", "form", "suffix"])


def _fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, r, f, s, *x) for k, r, f, s in zip(b["kind"], b["rep"], b["form"], b["suffix"]) for x in fine_keys(k, f, s)]
        yield pd.DataFrame(rows, columns=["kind", "rep", "form", "suffix", "role", "key"])


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, r, f, s, x) for k, r, f, s, key in zip(b["kind"], b["rep"], b["form"], b["suffix"], b["key"]) for x in finer_keys(f, s, key)]
        yield pd.DataFrame(rows, columns=["kind", "rep", "form", "suffix", "key"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for k, a, c, fa, fc in zip(b["kind"], b["a"], b["b"], b["form_a"], b["form_b"]):
            sure, first = (same_company if k == "company" else same_person)(fa, fc)
            if sure:
                short = a if len(fa.split("|")[0].split()) == 1 else c
                rows.append((k, a, c, sure, short, first))
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "sure", "short", "first"])


def _looks() -> list[F.Column]:
    """What pairs are told apart by before they are compared: number of tokens, letters as a set of bits, whether a short name or one that has such is among the tokens."""
    tokens = F.split(F.split("form", "[|]")[0], " ")
    bits = F.aggregate(F.array_distinct(F.split(F.array_join(tokens, ""), "")), F.lit(0).cast("bigint"), lambda b, c: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(61)))))
    known = F.array(*[F.lit(x) for x in sorted({*NICK, *(n for v in NICK.values() for n in v)})])
    return [F.size(tokens).alias("tokens"), bits.alias("bits"), F.arrays_overlap(tokens, known).alias("nick")]


def _may_match() -> F.Column:
    """Holds of all pairs that ``same_person`` or ``same_company`` can take: a slip changes the set of letters by two at most, tokens run together may have lost an "and"."""
    changed = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))
    a, b = F.col("tokens_a"), F.col("tokens_b")
    firms = changed <= 2 * F.least(a, b) + F.when(a != b, 3).otherwise(0)
    persons = F.when((a > 1) & (b > 1), (a == b) & (F.col("nick_a") | F.col("nick_b") | (changed <= 2 * a))).otherwise(True)
    return F.when(F.col("kind") == "company", firms).otherwise(persons)


def classes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """kind, group, id, form of the rows (kind string: company or else a person; id bigint; name string; mail string; further columns are ignored): one group for all whose names mean the same.

    Null and blank names, and names without a letter or digit, match nothing. Rows of equal names are one form; only distinct forms are blocked and
    compared. Blocks are suffixes of tokens; those that more than BLOCK
    forms share are refined by what another token of a match has to share (it without one letter, its full names), if need be by two,
    and by the first letter for forms with letters for given names. None is discarded. Pairs are compared token by token by the ratio of their longest common
    subsequence. A form with letters for given names joins a full one if all full ones that it fits have one given name,
    or else those that share its mail address. Matches are closed over chains; ``group`` is the smallest id of the group's first form.
    """
    work = Workspace(spark, "names")
    text = rows.select("kind", F.col("id").cast("bigint").alias("id"), "name", F.nullif(F.trim(F.lower("mail")), F.lit("")).alias("mail")).where("kind is not null and id is not null")
    forms, n = work.write(text.mapInPandas(_forms, "kind string, id bigint, mail string, form string"), "forms", rows=F.count(F.lit(1)))
    reps = work.table(forms.groupBy("kind", "form").agg(F.min("id").alias("rep")), "reps")
    keys = work.table(reps.mapInPandas(_suffixes, "kind string, rep bigint, form string, suffix string"), "keys")
    sizes = work.table(keys.groupBy("kind", "suffix").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    coarse = keys.join(sizes.where(F.col("size") <= BLOCK), ["kind", "suffix"], "left_semi").select("kind", F.col("suffix").alias("key"), "rep", "form")
    hot = keys.join(sizes.where(F.col("size") > BLOCK), ["kind", "suffix"], "left_semi").select("kind", "rep", "form", "suffix")
    fine = work.table(hot.mapInPandas(_fine, "kind string, rep bigint, form string, suffix string, role string, key string"), "fine")
    same = fine.where("role = 'same'").drop("role")
    by = ["kind", "suffix", "key"]
    wide = work.table(same.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > BLOCK) & (F.split("key", r"\|")[0].cast("int") > 2)).select(*by), "wide")
    finer = same.join(wide, by, "left_semi").select("kind", "rep", "form", "suffix", "key").mapInPandas(_finer, "kind string, rep bigint, form string, suffix string, key string").distinct()
    # keys as hashes: two keys of one hash only make a pair more to compare
    whole = lambda df: df.select("kind", F.xxhash64("suffix", "key").alias("h"), "rep")
    coarse = coarse.select("kind", F.xxhash64("key").alias("h"), "rep")
    block = work.table(reduce(DataFrame.unionByName, [coarse, whole(same.join(wide, by, "left_anti")), whole(finer)]), "blocks")
    side = lambda df, c: df.select("kind", "h", F.col("rep").alias(c))
    pairs = side(block, "a").join(side(block, "b"), ["kind", "h"]).where("a < b").select("kind", "a", "b")
    links = fine.where("role <> 'same'").select("kind", "rep", "role", F.xxhash64("suffix", "key").alias("h")).unionByName(joined_keys(reps))
    asked = side(links.where("role = 'ask'"), "a").join(side(links.where("role = 'answer'"), "b"), ["kind", "h"]).where("a <> b")
    pairs = pairs.unionByName(asked.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    looks = work.table(reps.select("kind", "rep", "form", *_looks()), "looks")
    end = lambda c: looks.select("kind", *[F.col(x).alias(c if x == "rep" else f"{x}_{c}") for x in looks.columns if x != "kind"])
    pairs = pairs.join(end("a"), ["kind", "a"]).join(end("b"), ["kind", "b"]).where(_may_match()).select("kind", "a", "b", "form_a", "form_b")
    found = work.table(pairs.mapInPandas(_compare, "kind string, a bigint, b bigint, sure int, short bigint, first string"), "found")
    weak = found.where("sure = 1")
    names = weak.groupBy("kind", "short").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    one = names.where((F.col("low") == F.col("high")) | (F.levenshtein("low", "high") <= F.when(F.least(F.length("low"), F.length("high")) >= 6, 2).otherwise(1))).select("kind", "short")
    # a form on a third of all rows is a hot key of this join
    numbered = work.table(lookup_join(forms, reps, ["kind", "form"], "inner", n["rows"]), "numbered")
    mails = work.table(numbered.where("mail is not null").select("kind", "rep", "mail").distinct(), "mails")
    shared = weak.join(mails.withColumnRenamed("rep", "a"), ["kind", "a"]).join(mails.withColumnRenamed("rep", "b"), ["kind", "b", "mail"])
    sure = found.where("sure = 2").select("kind", "a", "b").unionByName(weak.join(one, ["kind", "short"], "left_semi").select("kind", "a", "b")).unionByName(shared.select("kind", "a", "b"))
    groups = work.table(group_pairs(spark, sure), "groups")
    tagged = lookup_join(numbered, groups.withColumnRenamed("id", "rep"), ["kind", "rep"], "left", n["rows"]).select("kind", F.coalesce("group", "rep").alias("group"), "id", "form")
    return work.table(tagged, "tagged")


def variants(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Pairs (kind, a, b) with a < b of the rows of one class (see ``classes``), except for pairs whose middle letters clash; expanded at the very end."""
    tagged = classes(spark, rows)
    middle = lambda c: F.when(F.split(c, r"\|")[0].contains(" "), F.nullif(F.split(c, r"\|")[1], F.lit("")))
    a, b = (tagged.select("kind", "group", F.col("id").alias(c), middle("form").alias(f"mid_{c}")) for c in "ab")
    # blocks of a hot group are split over tasks by the skew join
    return a.join(b, ["kind", "group"]).where("a < b and (kind = 'company' or mid_a is null or mid_b is null or mid_a = mid_b)").select("kind", "a", "b")
