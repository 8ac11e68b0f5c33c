"""Per-document text quality statistics, and which documents are natural prose and which are lists, tables or junk.

Two passes. The first counts, over the lines of all documents, in how many lines that are built like sentences each word stands
and in how many others; the words that stand in a fixed share of the former, and clearly less often in the latter, are the common
words of the corpus, whatever its languages. The second tells every line (or, in a text of one long line, every run) apart by
combined rules on its separators, symbols, repetitions and common words, and adds the classes' characters up over the whole text.
No word list of any language is built in, and what is written in other scripts is judged by the same rules.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.runtime import cut, table

#: A common word stands in this share of the sentence lines or more, so there are no more such words than a line has words on
#: average over the share; and its share is this many times that among the other lines.
COMMON_SHARE, COMMON_TIMES = 0.002, 10.0
#: The ends of sentences in the scripts that have them, and how a word is found.
SENTENCE_END = r"[.!?\u2026\u3002\uff01\uff1f\u061f\u0964][\"'\u201d\u2019\u00bb)\]]*\\s*$"
WORD_PATTERN = r"[\\p{L}\\p{M}]+(?:['\u2019][\\p{L}\\p{M}]+)*"

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
END = re.compile(r"[.!?…:;。！？؟।][\"'”’»)\]]*$")
MARK = re.compile(r"^\s*(?:[-*+•·‣▪◦»>–—o]\s+|\[[ xX]\]\s*|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.):]\s+|\((?:\d{1,3}|[a-zA-Z]|[ivx]{1,5})\)\s*)")
HEX = re.compile(r"^\s*(?:0x)?[0-9a-fA-F]{4,}[:\s]+(?:[0-9a-fA-F]{2}\s+){4,}|^\s*(?:[0-9a-fA-F]{2}\s){8,}")
SYMBOL = re.compile(r"[^\w\s]|_")
BLOB = re.compile(r"[A-Za-z0-9+/=_\-]{24,}|[0-9a-fA-F]{20,}")
CONTROL = re.compile("[\u0080-\u009f�\u0000-\u0008\u000e-\u001f]|[ÃÂâãäåæçèéêëìíîïðñ][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
RULE = re.compile(r"^[\s|+:=\-_]*$")
TAG = re.compile(r"</?t[rdh]\b|</?table")
#: The letters of a keyboard's rows.
ROWS = [frozenset("qwertzuiopüå"), frozenset("qwertyuiop"), frozenset("azertyuiop"), frozenset("asdfghjklöäñøæ"), frozenset("yxcvbnm"), frozenset("zxcvbnm")]
#: Share of a text's characters that stand in lines, or in runs of ``LOOP`` words, seen before: one thing over and over. Shorter runs come
#: again in any long text.
MOST_REPEATED, LOOP = 0.65, 12
ODD = frozenset("$<>{}~`^\\|&!@#%*=")
LETTER = re.compile(r"[^\W\d_]")
VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûœæåøаеёиоуыэюяаɑ]", re.I)

MIN_SHARE = 0.5


def _solid(s: str) -> int:
    return sum(map(len, s.split()))


def repetition(units: list[str]) -> float:
    """Share of the characters in units that came before."""
    seen: set[str] = set()
    total = again = 0
    for u in units:
        total += len(u)
        if u in seen:
            again += len(u)
        seen.add(u)
    return again / total if total else 0.0


def top_ngram(words: list[str], n: int) -> float:
    """Share of the words' characters covered by the most frequent n-gram that occurs twice or more."""
    if len(words) < 2 * n:
        return 0.0
    counts = Counter(zip(*(words[i:] for i in range(n)), strict=False))
    gram, c = counts.most_common(1)[0]
    return min(1.0, c * sum(map(len, gram)) / max(1, sum(map(len, words)))) if c > 1 else 0.0


def repeated_ngrams(words: list[str], n: int) -> float:
    """Share of the words' characters that stand in an n-gram seen before, itself not counted."""
    seen: set[tuple[str, ...]] = set()
    again = [False] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            again[i : i + n] = [True] * n
        seen.add(g)
    total = sum(map(len, words))
    return sum(len(w) for w, x in zip(words, again, strict=True) if x) / total if total else 0.0


LATIN = re.compile(r"^[a-z\u00df-\u00f6\u00f8-\u024f'\u2019]+$")


def mash(words: list[str]) -> bool:
    """Random words: few letters of the alphabet, or words that cannot be spoken. The latter is known of words in Latin script alone;
    other scripts write vowels in other ways."""
    words = [w.lower() for w in words if len(w) > 1]
    letters = "".join(words)
    if not letters:
        return False
    # of so many letters drawn as a language draws them, more different ones would be expected
    kinds = len(set(letters))
    if any(row.issuperset(letters) for row in ROWS) and kinds > 3 or kinds <= 11 * (1 - 0.5 ** (len(letters) / 24)) - 1 and len(letters) > 3 * kinds:
        return True
    latin = [w for w in words if len(w) > 2 and LATIN.match(w)]
    bad = sum(1 for w in latin if not VOWEL.search(w) or re.search(r"[^aeiouyäöüáéíóúàèìòùâêîôûœæåø]{5,}", w))
    return bad > 0.3 * len(words) and bad >= 2


def classify(line: str, common_words: frozenset[str]) -> str:
    """prose, list, table, junk, or '' where a line alone can't tell (it then goes with its neighbours)."""
    s = line.strip()
    n = _solid(s)
    if not n:
        return ""
    bare = MARK.sub("", s)
    marked = bare != s
    words = WORD.findall(bare)
    lower = [w.lower() for w in words]
    letters = sum(map(len, words))
    cjk = 0 if s.isascii() else len(CJK.findall(s))
    if not s.isascii() and len(CONTROL.findall(s)) > max(1, 0.03 * n):
        return "junk"
    if cjk > 0.3 * n:
        return "prose"
    if HEX.search(s):
        return "junk"
    odd = len(set(s) & ODD)
    if odd >= 2:
        # letters lost to signs all over the line
        broken = sum(1 for t in s.split() if len(set(t) & ODD) >= 1 and LETTER.search(t) or len(t) > 1 and set(t) <= ODD)
        if broken > (0.2 if odd >= 4 else 0.4) * len(s.split()) and not TAG.search(s):
            return "junk"
    # tables
    if TAG.search(s):
        return "table"
    if RULE.match(s) and ("|" in s or "+" in s) and n >= 3:
        return "table"
    if s.endswith("\\\\") and "&" in s:
        return "table"
    common = sum(w in common_words for w in lower)
    share = common / len(words) if words else 0.0
    if "|" in s and share < 0.2 and (s.count("|") >= 2 or re.search(r"\S \| |\| \S", s)):
        return "table"
    few = len(set(s)) <= max(6, n // 3)
    top = max(s.count(c) for c in set(s) if not c.isspace()) / n if few else 0.0
    if n >= 8 and (top > 0.5 or letters < 0.35 * n and letters + sum(c.isdigit() for c in s) < 0.35 * n):
        return "junk"
    if "\t" in s.strip() and share < 0.2:
        return "table"
    if len(set(lower)) <= 0.25 * len(words):
        return "junk"
    if share > 0.8 and letters < 3 * len(words) and len(set(lower)) <= 0.7 * len(words):
        return "junk"  # nothing but short common words, again and again
    blob = sum(len(b) for b in BLOB.findall(s) if re.search(r"\d", b) or re.search(r"[a-z][A-Z]", b) or "/" in b or "+" in b)
    if blob > 0.5 * n and not re.match(r"^https?://", s):
        return "junk"
    for sep in (";", ","):
        cells = s.split(sep)
        if len(cells) >= 3 and share < 0.15 and not any(c.startswith(" ") for c in cells[1:] if c.strip()):
            return "table"
    if "  " in s and share < 0.15 and len(re.split(r"\s{2,}", s)) >= 3:
        return "table"
    if mash(words) and share < 0.2:
        return "junk"
    runs = [r for r in re.split(r"[,;/|·•]\s+|\s+[-–—/·•]\s+", bare) if r.strip()]
    if len(runs) >= 4 and share < 0.12 and sum(len(WORD.findall(r)) for r in runs) <= 4.0 * len(runs):
        return "list"
    if marked and len(words) <= 8 and share < 0.3:
        return "list"
    if share >= 0.15 and len(words) >= 4 or len(words) >= 3 and END.search(s) and share > 0:
        return "prose"
    # where the corpus has no common words, or none in this script, sentences are told by their shape
    if (not common_words or not any(LATIN.match(w) for w in lower)) and not marked and (len(words) >= 4 and END.search(s) or len(words) >= 8):
        return "prose"
    if len(words) <= 6 and share < 0.15:
        return "bare"
    return "prose" if share >= 0.1 else "bare"


def analyse(text: str, common_words: frozenset[str]) -> tuple[dict, dict]:
    """Characters of each class, and the statistics, of a whole text that is not blank."""
    lines = [x for x in re.split(r"[\r\n  ]+", text) if x.strip()]
    kinds = [classify(x, common_words) for x in lines]
    size = [_solid(x) for x in lines]
    n = len(lines)
    # bare short lines are items where they come in a row of three, else they go with what is around them (a heading, the end of a wrapped line)
    i = 0
    while i < n:
        if kinds[i] != "bare":
            i += 1
            continue
        j = i
        while j < n and kinds[j] == "bare":
            j += 1
        near = ([kinds[i - 1]] if i else []) + ([kinds[j]] if j < n else [])
        if j - i >= 3:
            new = "list"
        elif near:
            new = "prose" if "prose" in near else near[0]
        else:
            new = "list" if j - i >= 2 else "prose"
        if new == "prose" and all(k == "bare" for k in kinds) and n <= 2 and len(WORD.findall(text)) > 8:
            new = "prose"
        kinds[i:j] = [new] * (j - i)
        i = j
    total = sum(size) or 1
    chars = Counter()
    for k, c in zip(kinds, size, strict=True):
        chars[k or "prose"] += c
    words = WORD.findall(text)
    lower = [w.lower() for w in words]
    again = repetition([x.strip() for x in lines])
    ngrams = {k: top_ngram(lower, k) for k in (1, 2, 3, 4)}
    loops = repeated_ngrams(lower, LOOP)
    if max(again, loops) > MOST_REPEATED or max(ngrams.values()) > 0.5 and len(set(lower)) <= 0.4 * len(lower):
        if chars["table"] <= 0.5 * total:
            chars = Counter({"junk": total})
    symbols = len(SYMBOL.findall(text))
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    stats = {
        "n_words": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else None,
        "symbol_ratio": symbols / total,
        "line_end_share": sum(1 for x in lines if END.search(x.strip())) / n if n else None,
        "common_word_share": sum(w in common_words for w in lower) / len(lower) if lower else None,
        "duplicate_line_share": again,
        "duplicate_paragraph_share": repetition(paragraphs),
        "top_bigram_share": ngrams[2],
        "top_trigram_share": ngrams[3],
        "repeated_ngram_share": loops,
    }
    return {k: chars[k] / total for k in ("list", "table", "junk")}, stats


def kind_of(shares: dict) -> str:
    if sum(shares.values()) < MIN_SHARE:
        return "prose"
    return max(("junk", "table", "list"), key=lambda k: shares[k])


STATS = ["mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "duplicate_line_share", "duplicate_paragraph_share", "top_bigram_share", "top_trigram_share", "repeated_ngram_share"]
SCHEMA = "doc_id bigint, n_words bigint, " + ", ".join(f"{c} double" for c in STATS) + ", list_share double, table_share double, junk_share double, kind string"


def common_words(docs: DataFrame, share: float = COMMON_SHARE, times: float = COMMON_TIMES) -> frozenset[str]:
    """The common words of all documents (text), lower case. Lines are counted, not occurrences; counts are merged before the
    shuffle. What comes to the driver is bounded by the share."""
    lines = docs.where(F.col("text").isNotNull()).select(F.explode(F.split("text", r"[\r\n\u2028\u2029]+")).alias("line"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(WORD_PATTERN.replace("\\\\", "\\")), F.lit(0)))
    lines = lines.select(words.alias("w"), F.col("line").rlike(SENTENCE_END.replace("\\\\", "\\")).alias("end")).where("size(w) > 0")
    # a sentence: an end, and as many words as make one
    lines = lines.select("w", (F.col("end") & (F.size("w") >= 4)).alias("sentence"))
    # the empty word stands for the line itself, so that one pass counts the lines too
    c = lines.select("sentence", F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count_if("sentence").alias("s"), F.count_if(~F.col("sentence")).alias("o"))
    c = cut(c)
    n = c.where("w = ''").first()
    if n is None or not n["s"]:
        return frozenset()
    often = (F.col("w") != "") & (F.col("s") >= max(2, share * n["s"]))
    mine = F.col("s") / n["s"] >= times * (F.col("o") + 0.5) / max(1, n["o"])
    return frozenset(r[0] for r in c.where(often & mine).select("w").collect())


def _run(common: frozenset[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not isinstance(text, str) or not text.strip():
                    rows.append((doc_id, 0, *[None] * len(STATS), 0.0, 0.0, 0.0, "blank"))
                    continue
                shares, st = analyse(text, common)
                rows.append((doc_id, st["n_words"], *[st[c] for c in STATS], shares["list"], shares["table"], shares["junk"], kind_of(shares)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", *STATS, "list_share", "table_share", "junk_share", "kind"])

    return run


def text_quality(docs: DataFrame, common: frozenset[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the statistics, the shares of list, table and junk characters, and ``kind``:
    ``prose``, ``list``, ``table``, ``junk``, or ``blank`` for null, empty and blank texts (no words, null statistics).
    Repeated rows come out as often; other columns are ignored. The common words are those of ``docs`` unless given."""
    docs = docs.select("doc_id", "text")
    return docs.mapInPandas(_run(common_words(docs) if common is None else common), SCHEMA)


def p8_found(spark, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p8_stats(spark, sf_dir: str) -> DataFrame:
    q = text_quality(table(spark, sf_dir, "documents"))
    return q.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in q.dtypes])
