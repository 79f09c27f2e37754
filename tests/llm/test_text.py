"""Packing, decontamination, URL filters, chat formatting and token counts against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat, decontaminate, packing, token_counts, url_filter
from cadenza.llm.queries import RULES, byte_bpe, op2_pack_binary, op3_decontaminate, op6_url_filter, op8_chat_format, piece_file


def save(df, path, name="documents"):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- packing


def test_pieces(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    sets = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        sets[i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))] += 1
    pieces = packing.pack(docs, byte_bpe()).collect()
    whole, got = defaultdict(list), Counter()
    for p in pieces:
        assert p.length == 1 << p.bucket <= 1024 and len(p.ids) == 4 * p.length and p.offset == 0
        whole[p.doc_id, p.doc_tokens, p.start].append(bytes(p.ids))
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for (i, n), starts in ((k, sorted(s for j, m, s in whole if (j, m) == k)) for k in {(j, m) for j, m, _ in whole}):
        if len(whole[i, n, 0]) == 1 or i is not None:  # repeated rows have equal pieces
            copies = len(whole[i, n, 0])
            text = b"".join(whole[i, n, s][0] for s in starts)
            assert len(text) == 4 * n
            got[i, n, zlib.crc32(text)] += copies
    assert got == sets
    crcs = {(r.doc_id, r.start, r.ids_crc32) for r in op2_pack_binary(spark, save(docs, tmp_path)).collect()}
    assert crcs == {(p.doc_id, p.start, zlib.crc32(bytes(p.ids))) for p in pieces}


@pytest.mark.parametrize("text", ["don't  stop\n\n now ", " lead", "tail ", "\u00a0x \u2003y", "a\tb \t c", "<|endoftext|> x", "日本 語\u3000 z", "12 345  ٣", "  "])
def test_word_tokenizer(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    got = packing.WordTokenizer(byte_bpe()).encode_text(text)
    assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(spark):
    """Against the file's tokenizer as loaded, without any flag set."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    added = next(x.content for x in t.get_added_tokens_decoder().values())
    texts = [added, f"a stone {added} river", f"x{added}{added}  y\n", f"<{added[1:-1]} >", "plain text", ("stone " * 700 + added) * 2, None]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), byte_bpe()).collect()
    for i, text in enumerate(texts):
        own = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start))
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [int.from_bytes(own[k : k + 4], "little") for k in range(0, len(own), 4)] == want
        assert {p.doc_tokens for p in pieces if p.doc_id == i} == {len(want)}
    assert any(int.from_bytes(bytes(p.ids), "little") == t.token_to_id(added) for p in pieces if p.doc_id == 0)


def test_decompose():
    for n in range(1, 5000, 7):
        pieces = list(packing.decompose(n, 1024))
        assert sum(x for _, x in pieces) == n and all(b == a + x for (a, x), (b, _) in zip(pieces, pieces[1:]))
        assert all(x & (x - 1) == 0 and x <= 1024 for _, x in pieces)


# ---- decontamination

ITEMS = [(1, "The RIVER stone"), (2, "of"), (3, None), (4, "..."), (5, " ".join(f"w{k}" for k in range(14))), (6, "of"), (None, "lamp bread cloud"), (10, "a b c d e f g h i j k")]


def hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for i, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if k else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[s : s + k]:
                    hit |= set(range(p, p + k))
                    found |= {str(i)} if i is not None else set()
    near = 0
    for _, item in set(items):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        near += len(set(w)) > 1 and any(set(w) <= set(words[p : p + len(w) + 10]) for p in range(len(words)))
    return len(words), len(hit), sorted(found), near


def test_decontaminate(spark, docs, rows, tmp_path):
    extra = [(500, "x " + " ".join(f"W{k}" for k in range(2, 13)) + " y"), (501, " ".join(f"w{k}" for k in range(9))), (502, "of of of the river, stone!")]
    extra += [(503, "a b c d e f g h i j a b c d e f g h i j k"), (504, "river x the x x stone x x x river"), (505, "cloud " + "x " * 11 + "bread lamp"), (506, "cloud " + "x " * 10 + "bread lamp")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = save(table, tmp_path)
    save(tests, tmp_path, "benchmark")
    want = Counter()
    for i, t in rows + extra:
        n, h, ids, near = hits(t, ITEMS)
        want[i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0, near] += 1
    assert sum(w[6] for w in want) > 5
    assert Counter(map(tuple, op3_decontaminate(spark, d).collect())) == want
    clean = decontaminate.keep_clean(table, decontaminate.decontaminate(table, tests))
    assert Counter(map(tuple, clean.collect())) == Counter((i, t) for i, t in rows + extra if not hits(t, ITEMS)[1])
    assert decontaminate.decontaminate(table, tests.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(table.limit(0), tests).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "stone x x river"), (2, "stone x x x x x river"), (3, "stone stone")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "river stone")], "item_id long, text string")
    path = decontaminate.scratch(spark, "near")
    items = decontaminate.stage(decontaminate.items_of(tests, "item_id", "text", 10), f"{path}/items")
    vocab = decontaminate.stage(decontaminate.vocabulary(items), f"{path}/vocab")
    index = decontaminate.build_index(docs, vocab, "doc_id", "text", path)
    counts = index.where("not is_end").groupBy("term").count()
    found = decontaminate.proximity_matches(docs, items, index, vocab, counts, 3, "doc_id", "text", path)
    assert {(r.doc_id, tuple(r.places)) for r in found.collect()} == {(1, (3,))}


# ---- URL filters

URLS = [
    "https://www.example.com/en/1", "http://a.example.com/en/2", "https://b.net/es/x", "https://b.net/fr/stone-cloud", "https://redriver.com/", "https://redriver.com",
    "HTTPS://RedRiver.ORG/stone/7.html?q=1#t", "https://stonecloud.org/fr/1?x=http://y.com/", "x", None, "", "https://example.com/en", "https://notexample.com/en/3", "ftp://host.net/es/#/fr/",
    "http://stone77red.org/12", "http://stonestone.com/x",
]


def parse(u):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
    return (lower(m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


@functools.cache
def splits_of(name):
    """Every split of a name."""
    return [[]] if not name else [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in splits_of(name[k:])]


def likeliest(name, known, unseen):
    return max(splits_of(name), key=lambda ws: sum(known.get(w, unseen - 2.5 * len(w)) for w in ws))


def test_names_of_many_letters(spark):
    """A name far longer than any host's, and words of odd lengths."""
    pages = spark.createDataFrame([(1, "https://" + "redriver" * 1500 + ".com/", f"red river {'q' * 3000} of"), (2, None, None)], "page_id long, url string, html string")
    counts = url_filter.word_counts(pages)
    assert {r.word: r.n for r in counts.collect()} == {"red": 1, "river": 1, "q" * 3000: 1, "of": 1}
    names = spark.createDataFrame([("redriver" * 1500,), ("q" * 3000 + "red",), ("xofq",)], "name string")
    split = {len(r["name"]): r.words for r in url_filter.segment(names, counts).collect()}
    assert split == {12000: ["red", "river"] * 1500, 3003: ["q" * 3000, "red"], 4: likeliest("xofq", {"of": math.log(1 / 4)}, -math.log(5))}
    assert url_filter.judge_urls(pages, RULES, counts).count() == 2


def test_urls(spark, tmp_path):
    words = "stone cloud red river stone red the of"
    rows = [(k, u, f"<p class='redriver'>{words}</p><script>cloudred</script>", "h", "v") for k, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    counts = Counter(words.split())
    assert {r.word: r.n for r in url_filter.word_counts(pages.limit(1)).collect()} == counts
    total = sum(counts.values()) * len(rows)
    split = {r["name"]: r.words for r in url_filter.segment(spark.createDataFrame([(n,) for n in ("redriver", "stonecloud", "xq", "")], "name string"), url_filter.word_counts(pages)).collect()}
    assert split == {"redriver": ["red", "river"], "stonecloud": ["stone", "cloud"], "xq": ["xq"]}

    def tokens(u):
        host, path = parse(u)
        known = {w: math.log(n * len(rows) / total) for w, n in counts.items()}
        own = [w for name in re.findall(r"[^\W\d_]+", host) for w in likeliest(name, known, -math.log(total + 1))]
        own += ["0" * len(d) for d in re.findall("[0-9]+", host)]
        return own + ["/" + t for t in re.findall(r"(?:[^\W\d_]|0)+", re.sub("[0-9]", "0", path.lower()))]

    by, docs, vocab = {"allow": Counter(), "block": Counter()}, Counter(), {t for u in URLS for t in tokens(u)}
    for u in URLS * 2:
        if r := rule(*parse(u)):
            by[r.verdict].update(tokens(u))
            docs[r.verdict] += 1
    want = {}
    for k, u in enumerate(URLS * 2):
        r = rule(*parse(u))
        odds = math.log(docs["block"] / docs["allow"])
        for t in tokens(u):
            odds += math.log((by["block"][t] + 1) / (by["block"].total() + len(vocab))) - math.log((by["allow"][t] + 1) / (by["allow"].total() + len(vocab)))
        want[k] = (*parse(u), r.text if r else None, r.verdict if r else "block" if odds > 0 else "allow")
    got = op6_url_filter(spark, save(pages, tmp_path, "pages"))
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == want
    judged = url_filter.judge_urls(pages, RULES, url_filter.word_counts(pages))
    assert judged.count() == len(rows) and set(pages.columns) <= set(judged.columns)
    assert url_filter.judge_urls(pages.limit(0), RULES, url_filter.word_counts(pages.limit(0))).count() == 0
    one = url_filter.judge_urls(pages.where("url like '%.net%'"), RULES, url_filter.word_counts(pages))
    assert {r.verdict for r in one.collect()} == {"block"}


# ---- chat formatting

TURNS = [
    (1, 0, "system", "Be brief. ### </turn>"), (1, 1, "user", "hi " * 300), (1, 2, "assistant", "### assistant: \\</turn>\n</turn>\n"), (1, 3, "user", None),
    (1, 4, "assistant", "a" * 5000 + " " + "w " * 1200), (1, 5, "assistant", "\\\\### \\"), (1, 6, "user", ""), (1, 7, "assistant", "ends"),
    (2, 0, "assistant", ""), (3, 0, "us er: ", "x"), (3, 0, None, "y"), (3, None, "user", "z\r\n"), (None, 1, "user", "$1 \\$2"),
    *((4, k, ("user", "assistant")[k % 2], f"word{k} " * (k % 90)) for k in range(120)),
]


def test_chat(spark, tmp_path):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, window string").repartition(3)
    d = save(turns, tmp_path, "conversations")
    by = defaultdict(list)
    for c, k, role, text in TURNS:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    by[-7] = [(True, 0, "user", r"\### Assistant: </turn> ok"), (True, 1, "assistant", r"\### Assistant: </turn> ok")]
    want = {}
    for c, ts in by.items():
        ts = sorted(ts)
        said = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        want[c] = (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: tuple(r)[1:5] for r in op8_chat_format(spark, d).collect()} == want
    windows = chat.format_chat(turns, 256, 2, 64).where("conv_id = 4").orderBy("window").collect()
    assert len(windows) > 5 and any(w.n_repeated for w in windows)
    system = chat.format_chat(turns).where("conv_id = 1").collect()
    assert len(system) > 1 and all(w.text.startswith("### system: Be brief.") for w in system)
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_one_long_conversation(spark):
    """Linear in its turns; every window keeps the budget, and no turn is lost or repeated as new."""
    n = 40_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("w "), F.repeat(F.lit("xy "), (F.col("id") % 50).cast("int"))).alias("text"))
    turns = turns.withColumn("role", F.when(F.col("turn") == 0, "system").otherwise(F.col("role"))).withColumn("size", F.size(F.split("text", " ")))
    windows = chat.format_chat(turns, count=F.col("size")).select("window", "n_repeated", F.transform(chat.read_turns(F.col("text")), lambda t: t["text"]).alias("texts"), F.size("loss").alias("masks")).orderBy("window").collect()
    at = 0
    for w in windows:
        new = len(w.texts) - w.n_repeated
        assert w.window == at and new > 0 and (at == 0 or w.texts[0] == "w ")
        assert sum(len(t.split(" ")) + chat.MARK_TOKENS for t in w.texts) <= 1024
        assert w.masks == sum(1 for k in range(at, at + new) if k % 2)
        assert w.texts[w.n_repeated :] == ["w " + "xy " * (k % 50) for k in range(at, at + new)]
        assert at == 0 or 1 <= w.n_repeated <= 3
        at += new
    assert at == n and len(windows) < 1.5 * n * 31 / 1024


def test_windows_keep_the_budget(spark):
    """By the tokenizer's own counts; only a turn that is larger by itself passes it, alone in its window."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    speech = ["今日は天気がいいので、公園まで歩いて行きました。", "मैं आज बाज़ार गया और ताज़े फल ख़रीदे।", "Das Wetter ist heute schön, wir gehen spazieren.", "<|endoftext|> 1234567 !!!??? x\u00a0y  \t\n", "qzxj vkwq 0x1F ### </turn>", "It's what they've said: plain words."]
    rows = [(c, k, "system" if k == 0 else ("user", "assistant")[k % 2], " ".join(rng.choice(speech) if c > 5 else speech[c] for _ in range(rng.choice([1, 5, 20, 80])))) for c in range(12) for k in range(30)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    real = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text") if Path("/root/testdata/sf0.01").exists() else turns.limit(0)
    tokenizer = Tokenizer.from_file(byte_bpe())
    for some, budget in ((turns, 1024), (turns, 200), (real, 1024), (real, 300)):
        windows = chat.format_chat(some, budget, 2, budget // 4, vocabulary=byte_bpe()).select("text", "n_repeated", F.size(chat.read_turns(F.col("text"))).alias("turns")).collect()
        sizes = [len(e.ids) for e in tokenizer.encode_batch([w.text for w in windows], add_special_tokens=False)]
        over = [w for w, n in zip(windows, sizes, strict=True) if n > budget]
        assert all(w.turns - w.n_repeated == 1 and w.n_repeated <= 1 for w in over)
        assert any(w.turns - w.n_repeated > 1 for w in windows)


def test_known_words_are_single_tokens():
    from tokenizers import Tokenizer

    words = chat.known_words(byte_bpe(), 300)
    assert len(words) == 300 and " the" in words and all(re.fullmatch(" ?[A-Za-z]+", w) for w in words)
    assert all(len(e.ids) == 1 for e in Tokenizer.from_file(byte_bpe()).encode_batch(words, add_special_tokens=False))


def test_escapes_are_reversible(spark):
    parts = ["\\", "### ", "</turn>", "\n", "x", "\\\\", "#"]
    texts = [a + b + c + e for a in parts for b in parts for c in parts for e in parts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    assert all(r.t == r.u for r in rows.select("t", chat.unescape(F.col("e")).alias("u")).collect())
    assert all(not re.search(r"(?<!\\)(### |</turn>)", r.e) for r in rows.collect())


# ---- token counts


def best_cut(token, scores, unknown):
    """By recursion over all cuts: (score, -pieces)."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for j in range(1, len(token) + 1):
        for i in range(j):
            s, pieces = scores.get(token[i:j]), 1
            if s is None and j - i == 1:
                pieces = len(token[i:j].encode())
                s = unknown * pieces
            if s is not None:
                best[j] = max(best[j], (best[i][0] + s, best[i][1] - pieces))
    return -best[-1][1]


@pytest.mark.parametrize("each", [500_000, 20])
def test_token_counts(docs, rows, empty, monkeypatch, each):
    monkeypatch.setattr(token_counts, "RANGE_WORDS", each)
    scores = token_counts.zipf_scores(token_counts.pieces_of(piece_file()))
    unknown = min(scores.values()) - token_counts.BYTE_PENALTY
    memo: dict = {}
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w in words:
            if w not in memo:
                memo[w] = best_cut("▁" + w, scores, unknown) if len(w) < 500 else None
        if None not in (memo[w] for w in words):
            want[i, len(words), sum(memo[w] for w in words)] += 1
    got = Counter(map(tuple, token_counts.count_tokens(docs, piece_file()).collect()))
    assert not want - got and got.total() == len(rows)
    assert token_counts.count_tokens(empty, piece_file()).count() == 0


def test_terminal_counts_are_stored(spark, docs, rows, tmp_path, monkeypatch):
    """Each different word once, whatever the ranges; ranges are cut between words, so prefixes are shared but at borders."""
    monkeypatch.setattr(token_counts, "RANGE_WORDS", 8)
    token_counts.count_tokens(docs, piece_file(), store=f"file://{tmp_path}/t").count()
    stored = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()]
    words = {w for _, t in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    trie = token_counts.Trie(token_counts.scores_of(piece_file()))
    assert sorted(stored) == sorted((w, trie.count(w.encode())) for w in words)
    table = token_counts.blocks_of(docs.select(F.col("doc_id").alias("id"), "text"), f"file://{tmp_path}/b")
    cuts = token_counts.cuts_of(table, 5)
    assert cuts == sorted(set(cuts)) and 1 <= len(cuts) <= 4
    ends = token_counts.counted(table, cuts, piece_file()).where("block is null").orderBy("range").collect()
    parts = [token_counts.words_of(bytes(r["words"])) for r in ends]
    assert [w for p in parts for w in p] == sorted(w.encode() for w in words)
    assert token_counts.cuts_of(table, 1) == [] and token_counts.cuts_of(table.limit(0), 4) == []


def test_trie_shares_prefixes():
    scores = {"▁": -2.0, "▁a": -1.0, "b": -1.5, "ab": -1.0, "abab": -1.2}
    trie = token_counts.Trie(scores)
    words = ["a", "ab", "aba", "abab", "ababé", "abb", "b" * 300, "é", "éa", "ab" * 400]
    for w in sorted(words):
        assert trie.count(w.encode()) == best_cut("▁" + w, scores, trie.unknown)
    short = {("▁" + w)[:k] for w in words if len(w) < 256 for k in range(1, len(w) + 2)}
    assert trie.made == len(short) + sum(len(w) + 1 for w in words if len(w) >= 256)


def test_counts_equal_sentencepiece():
    """SentencePiece's own unigram search, given the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(piece_file(), "rb").read())
    scores = token_counts.zipf_scores(token_counts.pieces_of(piece_file()))
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = scores[p.piece]
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    trie = token_counts.Trie(scores)
    for w in ["the", "stones", "unbelievable", "Donaudampfschiff", "xqzt", "naïve", "1234567", "and/or", "lower-case"]:
        assert trie.count(w.encode()) == len(sp.encode(w)), w
