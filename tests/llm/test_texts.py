"""Texts: the trie against the library and plain merging, mixtures against a plain draw, the classes of lines."""

import collections
import math
import os

import pytest

from kinetrail.llm import mixing, quality, tokens

HAVE = os.path.exists(tokens.vocabulary())
need = pytest.mark.skipif(not HAVE, reason="no tokenizer files")
TEXTS = [
    None, "", "   \n", "Hello world's end", "don't  stop", "<|endoftext|> is text", "日本語のテキスト", "🧪🧬 naïve café", "x" * 3000, "ab" * 999, "\t\ta  b\r\n c ", "1234567890 12,5%", "​zero﻿", "ﬁ́ 𝒜",
]


@need
def test_trie_is_the_library(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    ref = Tokenizer.from_file(tokens.vocabulary())
    ref.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, tokens.vocabulary()).collect()}
    for i, t in enumerate(TEXTS + TEXTS):
        assert got[i] == ref.encode(t or "", add_special_tokens=False).ids, t
    assert tokens.encode_corpus(df.limit(0), tokens.vocabulary()).count() == 0


@need
def test_trie_random_words():
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeioutnshr lLQ.0_é\n") for _ in range(rnd.randint(1, 50))) for _ in range(3000)]
    ref = Tokenizer.from_file(tokens.vocabulary()).encode_batch(words, add_special_tokens=False)
    assert tokens.TrieEncoder(tokens.vocabulary()).encode_batch(words) == [r.ids for r in ref]


def test_plan_keeps_shares_and_caps():
    t = [{"source": "a", "weight": 0.5, "max_repeats": 2}, {"source": "b", "weight": 0.3, "max_repeats": 4}, {"source": "none", "weight": 0.2, "max_repeats": 3}, {"source": "z", "weight": 0.0, "max_repeats": 1}]
    rows = {r["source"]: r for r in mixing.plan(t, {"a": 1000, "b": 50, "z": 9})}
    assert rows["b"]["budget"] == 200 and rows["b"]["epochs"] == 4
    assert abs(rows["a"]["budget"] / 200 - 0.5 / 0.3) < 0.01
    assert rows["none"]["budget"] == rows["z"]["budget"] == 0
    assert mixing.plan(t, {}) and all(r["budget"] == 0 for r in mixing.plan(t, {}))


def test_mixture_against_plain_draw(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, rnd.choice("aaaab"), rnd.randint(0, 30), rnd.choice([1.0, 0.2])) for i in range(600)] + [(900, None, 5, 1.0), (901, "other", 5, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, quality double")
    t = [{"source": "a", "weight": 0.6, "max_repeats": 2}, {"source": "b", "weight": 0.4, "max_repeats": 3}, {"source": "c", "weight": 0.1, "max_repeats": 3}]
    from pyspark.sql import functions as F

    u = {r.doc_id: r.u for r in df.select("doc_id", ((F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)).alias("u")).collect()}
    tokens_ = collections.Counter()
    for i, s, n, q in rows:
        tokens_[s] += n
    want = collections.Counter()
    for r in mixing.plan(t, tokens_):
        docs = sorted([(-math.log(u[i]) / q, i, n) for i, s, n, q in rows if s == r["source"] and n > 0])
        upto = 0
        for _, i, n in docs:
            want[i] += r["epochs"]
            if upto + n <= r["rest"] or (upto < r["rest"] and upto + n - r["rest"] < r["rest"] - upto):
                want[i] += 1
            upto += n
    got = {r.doc_id: r.copies for r in mixing.mix(df, t).collect()}
    assert got == {i: c for i, c in want.items() if c}
    s = {r.source: r for r in mixing.shares(mixing.mix(df, t), t).collect()}
    assert abs(s["a"].share - 0.6) < 0.02 and s["c"].share == 0 and s["b"].most_copies <= 3
    assert mixing.mix(df.limit(0), t).count() == 0


#: Words that a corpus of these languages would show to be common.
COMMON = frozenset("the was for most of it did not move until and then this is hard to say would go on we what that by ob es sich um hier kaum nach der war zu sehen nicht mehr with are be as in".split())
PROSE = "The animal was seen near the wall for most of the session. It did not move until the light changed, and then it ran.\nWhy this happened is hard to say."


@pytest.mark.parametrize(
    "text,kind",
    [
        (PROSE, "prose"),
        ("the viewer stopped at frame 2 and would not go on until we closed it what matters more is that the fps was set by hand", "prose"),
        ("Ob es sich um Erstarren handelt, lässt sich hier kaum sagen. Nach der Pause war es nicht mehr zu sehen.", "prose"),
        ("尤度は11.6で、特に問題はなかった。静止が74回見られたので、もう一度確認した。", "prose"),
        ("- nose\n- left ear\n- weigh the wall\n- slow digging", "list"),
        ("nose\nleft ear\nslow digging\nweigh the wall", "list"),
        ("slow digging, left ear, wall, weigh the wall, nose, late rest, tail base", "list"),
        ("    o left ear\n- tail\n    o nose\n- late rest", "list"),
        ("| a | b |\n| --- | --- |\n| sham | 0.3 |\n| control | 2 |", "table"),
        ("group,speed,clock\nsham,1.5,10:30\ncontrol,,11:30\nsham,2.5,-", "table"),
        ("group   speed  frame\nsham    1.5    14\nsham    2.5    15", "table"),
        ("a & b & c \\\\\nsham & nose & rest \\\\", "table"),
        ("<table><tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr></table>", "table"),
        ("xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "junk"),
        ("sdfk jlks asdf lkaaj dsflk ajsd fkj asdlf kjas", "junk"),
        ("Retry Cancel OK " * 20, "junk"),
        ("00000000  3a e0 db 70 4d 82 46 56 73 38 c9 21 18 3b f1 98\n00000010  67 6d 0b 0d 91 1c ca e5 6d fa df f1 58 fb 5d fc", "junk"),
        ("of it and with are the to was that of it is be as it be it with in it as was was and was as is that be", "junk"),
        ("Retry Cancel OK " * 3, "junk"),
        ("Животное долго стояло у стены и не двигалось. Потом оно медленно пошло к центру клетки.", "prose"),
        ("Το ζώο έμεινε κοντά στον τοίχο για πολλή ώρα. Μετά κινήθηκε προς το κέντρο.", "prose"),
        ("بقي الحيوان قرب الجدار لفترة طويلة. ثم تحرك ببطء نحو الوسط.", "prose"),
        ("जानवर बहुत देर तक दीवार के पास रहा। फिर वह धीरे से बीच में आया।", "prose"),
        ("нос, хвост, левое ухо, правое ухо, шея, спина", "list"),
        (PROSE + "\n- nose\n- ear\n- tail", "prose"),
        (PROSE + " <|endoftext|>", "prose"),
    ],
)
def test_kinds(text, kind):
    assert quality.kind_of(quality.analyse(text, COMMON)[0]) == kind


def test_quality_table(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, PROSE), (4, PROSE), (5, "- nose\n- ear\n- tail\n- wall"), (6, "a " * 200_000)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id bigint, text string, kind string, n_words int")
    got = quality.text_quality(df, COMMON).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].kind for i in (1, 2, 3, 4, 5, 6)] == ["blank"] * 3 + ["prose", "list", "junk"]
    assert by[1].n_words == 0 and by[1].mean_word_length is None
    assert by[4].duplicate_line_share == 0 and 0.3 < by[4].common_word_share < 1
    assert quality.repetition(["a", "b", "a", "a"]) == 0.5
    assert quality.text_quality(df.limit(0)).count() == 0


def test_common_words_come_from_the_corpus(spark):
    lines = [f"The tarn was {w} near the quay and it would not stay." for w in ("seen", "left", "marked", "late", "wet", "cold")] * 10
    items = ["- quay\n- tarn\n- wet rope", "quay, tarn, rope, net, sail", "tarn;quay;net"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines + items + [None, ""])], "doc_id bigint, text string").repartition(4)
    got = quality.common_words(df)
    assert {"the", "was", "near", "and", "it", "would", "not", "stay"} <= got and not {"tarn", "quay", "net", "rope"} & got
    assert quality.common_words(df.limit(0)) == frozenset()
    kinds = {r.doc_id: r.kind for r in quality.text_quality(df).collect()}
    assert kinds[0] == "prose" and kinds[60] == "list" and kinds[62] == "table" and kinds[180] == "blank"


def test_counts_are_lengths_and_weights_have_a_value(spark):
    texts = ["nose and tail", None, "", " ", "a a a a a a", "3;4;5;6", "нос и хвост"]
    enc = tokens.encoder(tokens.vocabulary())
    assert enc.count_batch(texts) == [len(x) for x in enc.encode_batch(texts)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    q = {r.doc_id: (r.n_tokens, r.quality) for r in mixing.size_and_quality(df, tokens.vocabulary()).collect()}
    assert [q[i][0] for i in range(7)] == enc.count_batch(texts)
    assert q[0][1] == q[6][1] == 1.0 and q[4][1] < 0.3 and all(q[i][1] == mixing.LEAST_QUALITY for i in (1, 2, 3, 5))
