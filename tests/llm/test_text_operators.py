"""Operators on single texts against the libraries, naive scans and exact round trips."""

import hashlib
import json
import random
import re
import time
import zlib

import pytest

from ragweave.llm import jpeg, pieces, pii, quality, tokencount

NASTY = ["", None, " ", "a", "\n\n", "x\x00y", "é́ ﬁ", "▁ ▁▁a", "<|endoftext|> a<|endoftext|>", "日本語 テキスト", "w " * 30_000, "z" * 50_000, "a b c d e a b c d e", "<s> </s>", "\ud7a3 👍🏽", "+1 (555) 010-9999 a@b.co"]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.selectExpr("*", "1 AS size", "2 AS n_tokens", "3 AS spans", "4 AS kept", "5 AS media") if extra else df


def mixed(seed, alphabet, n, longest=25):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, longest))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = NASTY + mixed(1, [*" ▁\n\tab'1 é日\x00　\x85👍́<", "<s>", "the", " and"], 500)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in pieces.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))), repr(t)
    assert pieces.encoder(pieces.default_model()).by_chunk


def test_pieces_small_table(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    enc = pieces.Encoder(pieces.default_model())
    texts = mixed(2, [*" abc", "é", "▁", "\x00", "👍"], 300)
    assert [r[0] for s in texts for r in enc.encode([s])] == [" ".join(map(str, enc.model.encode(s, add_eos=True))) for s in texts]
    assert len(enc.table) <= 3
    enc.by_chunk = False  # whole texts give the same
    assert [r[2] for r in enc.encode(texts)] == [enc.model.decode(enc.model.encode(s)) for s in texts]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokencount.default_model())
    texts = NASTY + mixed(3, [*" _\n\tab'1²é日\x1c\x85👍́<", "<|endoftext|>", "the", "'s", "  "], 500)
    got = {r["doc_id"]: r for r in tokencount.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), repr(t)


def test_stable_characters_are_cut_alike():
    counts = tokencount.Counts(tokencount.default_model())
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not tokencount._OTHER.search(c)]
    texts = [f"a{c}b1{c}2 {c} {c}" for c in chars]
    assert counts.count(texts) == counts.whole(texts)


def test_every_vocabulary_entry_is_one_token():
    """Ranks encode a known entry as itself; the library's merges must do so too."""
    counts = tokencount.Counts(tokencount.default_model())
    counts.library.encode_special_tokens = True
    words = []
    for w in tokencount._byte_ranks(json.loads(counts.library.to_str())):
        try:
            words.append(w.decode())
        except UnicodeDecodeError:
            pass
    assert set(counts.whole(words)) == {1}


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 2)
    counts = tokencount.Counts(tokencount.default_model(), {"the": 1})
    texts = mixed(4, ["the", " cat", " dog", "s", " "], 200)
    assert counts.count(texts) == counts.whole(texts) and len(counts.lengths) <= 3


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if fine(k, m[0]))


def test_base_spans_equal_plain_scans():
    parts = ["@", ".", "-", "+", "1", "23", "4539578763621486", "a", "b_", "%", " ", "(", ")", "255", "é", "\n", "0", "12.3.4.5", "x@y.z", "+49 30 1234567"]
    for t in mixed(5, parts, 20_000, 14):
        assert pii.base_spans(t) == naive(t), repr(t)


def test_base_spans_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 200_000, "a@" * 100_000, "+1" + " " * 300_000):
        pii.base_spans(t)


def train_texts(n=150):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(30)]
        w[5], w[12], w[20] = f"{word()}@{word()}.com", f"+49{r.randint(10**8, 10**9)}", ".".join(str(r.randint(0, 255)) for _ in range(4))
        w[25] = str(r.randint(1, 99))
        out.append(" ".join(w))
    return out


def test_field_labels_held_out_tokens():
    """Held-out accuracy: without their clamps the field finds most tokens of base spans, and few others."""
    model = pii.fit(train_texts()[:100])
    graph = pii.Graph()
    for i, t in enumerate(train_texts()[100:]):
        graph.add(i, t, pii.base_spans(t))
    truth, graph.label = graph.label, [0] * len(graph.label)
    best = pii.marginals(graph, model).argmax(1)
    assert sum(a == b for a, b in zip(best, truth, strict=True)) / len(truth) > 0.9


def test_repeats_share_labels():
    """What repeats a base span in another form is found by the skip potentials, and by nothing else."""
    model = pii.fit(train_texts())
    texts = ["call +4930123456789 or ab cd ef then 4930123456789 again", "mail johnsmith@x.org or ask johnsmith there", "ab 4930123456789 cd ef", "ask johnsmith there", "ab cd +4930123456789 ef 4930987654321 gh"]
    found = pii.find(texts, model)
    words = lambda i: [(pii.KINDS[k], texts[i][a:b]) for a, k, b in found[i][1]]
    assert words(0) == [("phone", "+4930123456789"), ("phone", "4930123456789")]
    assert words(1) == [("email", "johnsmith@x.org"), ("email", "johnsmith")]
    assert [words(i) for i in (2, 3, 4)] == [[], [], [("phone", "+4930123456789")]]
    unary, chain, skip = model
    without = pii.find(texts, (unary, chain, skip * 0))
    assert [len(every) for _, every in without[:1] + without[2:]] == [1, 0, 0, 1]


def exact_marginals(graph, model):
    """By enumeration of all labellings."""
    import itertools

    import numpy as np

    unary, c, s = model
    x, y, chain, skip = graph.arrays()
    total = np.zeros((len(x), pii.L))
    for labels in itertools.product(*([k] if k else range(pii.L) for k in y)):
        score = sum((x[i] @ unary)[k] for i, k in enumerate(labels)) + sum(c[labels[i], labels[j]] for i, j in chain) + sum(s[labels[i], labels[j]] for i, j in skip)
        total[np.arange(len(x)), labels] += np.exp(score)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("text", "loops"), [("1111111 b 2222222 3333333 a@b.cd b 1111111", False), ("+4930123456789 x 4930123456789 5 x 5", False), ("1234567 7654321 x 1234567 7654321", True), ("1234567 a 1234567 9 a 1234567 9 8", True)])
def test_message_passing_by_enumeration(text, loops):
    """Exact without loops; near the truth with them."""
    import numpy as np

    r = np.random.default_rng(7)
    pair = lambda: (lambda m: (m + m.T) / 2)(r.normal(0, 0.4 if loops else 1.5, (pii.L, pii.L)))
    model = r.normal(0, 0.3, (pii.N_FEATURES, pii.L)), pair(), pair()
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    assert graph.skip
    assert np.allclose(pii.marginals(graph, model), exact_marginals(graph, model), atol=0.05 if loops else 1e-5)


def test_labels_reach_every_repetition():
    """A clamped label travels all links, and a document's marginals don't depend on the others of its batch."""
    import numpy as np

    r = random.Random(12)
    couple = np.full((pii.L, pii.L), -4.0)
    np.fill_diagonal(couple, 4.0)
    unary = np.zeros((pii.N_FEATURES, pii.L))
    unary[0, 0] = 0.01  # a token by itself is outside
    model = unary, np.zeros((pii.L, pii.L)), couple
    text = "+4930123456789 " + " ".join(f"{'abcdefghij'[r.randrange(10)] * 4} 4930123456789" for _ in range(60))
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    assert len(graph.skip) == 60 and sum(map(bool, graph.label)) == 1
    p = pii.marginals(graph, model)
    assert (p.argmax(1) == 4).all() and p[-1, 4] > 0.9
    both = pii.Graph()
    for i, t in enumerate([text, "1 2 3 1 2 3", text + " 5 6 5"]):
        both.add(i, t, pii.base_spans(t))
    assert np.allclose(pii.marginals(both, model)[: len(p)], p, atol=1e-9)


def test_pii_rows(spark):
    texts = [*NASTY, *train_texts(20)]
    rows = {r["doc_id"]: r for r in pii.annotate(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        want = naive(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(pii.described(want).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in want) for j in range(4)]
        assert set(pii.described(want).split(",")) - {""} <= set(rows[i]["spans"].split(","))


def test_jpeg_round_trip(spark):
    r = random.Random(7)
    texts = [*NASTY, "".join(map(chr, r.choices(range(1, 0xD000), k=5000))), "q" * (64 * jpeg.MAX_ROWS + 5)]
    rows = {x["doc_id"]: x for x in jpeg.report(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        data = jpeg.padded((t or "").encode())
        assert len(data) % 64 == 0 and data
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest())
        assert rows[i]["tail_crc32"] == zlib.crc32(data[-64:]) and rows[i]["feature"]
    assert rows[0]["feature"] == rows[1]["feature"] and rows[0]["media_sha256"] == rows[1]["media_sha256"]


def test_jpeg_general_images():
    """A three-component 4:2:0 image with AC coefficients, written here bit by bit."""
    r = random.Random(8)
    units, dc_codes = 6, {s: (c, n) for s, c, n in jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)}
    ac_counts, ac_symbols = (0, 2, 1, *(0,) * 13), (0x00, 0x11, 0xF0)
    ac_codes = {s: (c, n) for s, c, n in jpeg.codes(ac_counts, ac_symbols)}
    bits, last, luma = "", [0, 0, 0], []
    for _ in range(units):
        for comp in (0, 0, 0, 0, 1, 2):
            value = r.randint(-60, 60)
            diff, last[comp] = value - last[comp], value
            size = abs(diff).bit_length()
            code, n = dc_codes[size]
            bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
            if r.random() < 0.5:  # a run of 16 zeros, one zero and a coefficient
                for s, extra in ((0xF0, ""), (0x11, "1")):
                    code, n = ac_codes[s]
                    bits += f"{code:0{n}b}" + extra
            code, n = ac_codes[0]
            bits += f"{code:0{n}b}"
            if comp == 0:
                luma.append(value)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = jpeg._segment(0xC4, bytes([0, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS]) + bytes([0x10, *ac_counts, *ac_symbols]))
    data = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, *[4] * 64])) + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xC0, frame) + tables + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    thumb = jpeg.thumbnails([data, data[:-20], b"\x89PNG", None])
    assert thumb[1] is None and thumb[2] is None and thumb[3] is None and thumb[0].shape == (4, 6)
    for u in range(units):
        for k in range(4):
            want = max(0, min(255, (luma[4 * u + k] * 4 + 1024 + 4) >> 3))
            assert thumb[0][2 * (u // 3) + k // 2, 2 * (u % 3) + k % 2] == want


def test_jpeg_header_bytes(spark):
    """Whatever a header byte says, a damaged image has a thumbnail or none, and its neighbours keep theirs."""
    good = jpeg.write_many([bytes(range(64)) * 3])[0]
    r = random.Random(6)
    ends = good.index(b"\xff\xda") + 14
    bad = [good[:at] + bytes([v]) + good[at + 1 :] for at in range(ends) for v in {0, 1, 255, good[at] ^ 1, r.randrange(256)} - {good[at]}]
    bad += [good[:at] + bytes(r.randrange(256) for _ in range(4)) + good[at + 4 :] for at in range(0, ends, 3)]
    for frame in ((0, 8), (8, 0), (0, 0)):  # no rows, no columns
        at = good.index(b"\xff\xc0") + 5
        bad.append(good[:at] + frame[0].to_bytes(2, "big") + frame[1].to_bytes(2, "big") + good[at + 4 :])
    assert all(x is None for x in jpeg.thumbnails(bad[-3:]))
    want = jpeg.thumbnails([good])[0].tobytes()
    for at in range(0, len(bad), 100):
        found = jpeg.thumbnails([good, *bad[at : at + 100], good])
        assert found[0].tobytes() == found[-1].tobytes() == want
    media = spark.createDataFrame([(i, bytearray(x), "clash") for i, x in enumerate([good, *bad[:60], *bad[-3:]])], "doc_id long, media binary, feature2 string")
    rows = jpeg.read_media(media).collect()
    assert len(rows) == 64 and rows[0]["payload_sha256"] and all(x["feature"] is None for x in rows if x["doc_id"] > 60)


def test_jpeg_damaged_images():
    """Any damage gives no thumbnail, takes no other image along and costs no more memory than the file has data."""
    good = jpeg.write_many([bytes(range(64)) * 3])[0]
    frame = good.index(b"\xff\xc0")
    bad = [
        good[: frame + 12] + b"\x03" + good[frame + 13 :],  # a quantisation table that isn't there
        good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :],  # 65,535 x 65,535
        good[:-30], good[: frame + 6], b"\xff\xd8", b"\xff\xd8\xff", b"\xff" * 100,
    ]
    r = random.Random(9)
    bad += [bytes(r.randrange(256) if r.random() < 0.02 else b for b in good) for _ in range(300)]
    began = time.monotonic()
    found = jpeg.thumbnails([good, *bad, good])
    assert found[0] is not None and (found[0] == found[-1]).all() and found[1:8] == [None] * 7
    assert time.monotonic() - began < 60


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(spark):
    texts = NASTY + mixed(9, ["a ", "b ", "c ", "\n", "# ", "é|", "\t"], 300, 60)
    rows = {r["doc_id"]: r for r in quality.judge(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in quality.STATS) == brute_quality(t), repr(t)
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_quality_outliers(spark):
    """The estimate equals a plain numpy one, and planted outliers go while the rest stays."""
    import numpy as np

    r = random.Random(10)
    word = lambda: "".join(r.choices("abcdefghij", k=r.choice((3, 4, 5, 6, 7))))
    clean = [" ".join(word() for _ in range(r.randint(40, 400))) for _ in range(400)]
    odd = [" ".join(word() + "%%%" for _ in range(120)) for _ in range(60)] + [" ".join(word() * 9 for _ in range(100)) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(clean + odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {x["doc_id"]: x for x in quality.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(len(clean))) and not any(got[i]["kept"] for i in range(len(clean), len(rows)))
    assert sorted(x["doc_id"] for x in quality.keep_quality(df).collect()) == list(range(len(clean)))

    def plain(i):
        n, chars, sym, dup, rep, _ = brute_quality(rows[i][1])
        n += quality.PRIOR_WORDS
        return [np.log((chars + quality.PRIOR_WORDS * quality.PRIOR_LENGTH) / n), (sym / n) ** 0.5, (dup / n) ** 0.5, (rep / n) ** 0.5]

    for key in {(x[2], x[3]) for x in rows}:
        ids = [x[0] for x in rows if (x[2], x[3]) == key and not brute_quality(x[1])[5]]
        x = np.round(np.array([plain(i) for i in ids]) * quality.SCALE) / quality.SCALE
        floor = np.diag(np.square(quality.FLOORS))
        q = np.percentile(x, [25, 50, 75], axis=0)
        spread = np.maximum(((q[2] - q[0]) / 1.349) ** 2, np.diag(floor))
        factor = quality.SUPPORT / quality._chi2_cdf(quality._chi2_quantile(quality.SUPPORT, 4), 6)
        d2 = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
        z = (x - q[1]) / np.sqrt(spread)
        z /= np.maximum(np.sqrt((z**2).sum(1)), 1e-12)[:, None]
        turned = z.T @ z / len(x) * np.sqrt(np.outer(spread, spread))
        found = []
        for center, cov in ((q[1], np.diag(spread) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor), (q[1], turned + floor)):
            for _ in range(quality.MAX_STEPS):
                bins = np.floor(np.log(d2(center, cov) + 1e-4) * 16)
                need = int(np.ceil(len(ids) * quality.SUPPORT))
                least = np.sort(bins)[need - 1]
                weight = np.where(bins < least, 1.0, np.where(bins == least, (need - (bins < least).sum()) / (bins == least).sum(), 0))
                center = weight @ x / need
                cov = ((x.T * weight) @ x / need - np.outer(center, center)) * factor + floor
                found.append((np.linalg.slogdet(cov)[1], center, cov))
                if len(found) > 1 and _ > 0 and found[-1][0] >= found[-2][0] - quality.CONVERGED:
                    break
        _, center, cov = min(found, key=lambda f: f[0])
        assert np.allclose([got[i]["distance2"] for i in ids], d2(center, cov), rtol=1e-3, atol=1e-4)


def test_quality_small_groups(spark):
    """A small group is judged by its own rows, the same beside a hot source as alone; one without a covariance by its language."""
    r = random.Random(11)
    word = lambda low, high: "".join(r.choices("abcdefghij", k=r.randint(low, high)))
    hot = [(i, " ".join(word(3, 7) for _ in range(150)), "en", "hot") for i in range(300)]
    few = [(300 + i, " ".join(word(20, 30) for _ in range(150)), "fi", "few") for i in range(20)]
    few.append((320, " ".join(word(3, 7) for _ in range(150)), "fi", "few"))
    one = [(330, " ".join(word(20, 30) for _ in range(150)), "fi", "one"), (331, " ".join(word(3, 7) for _ in range(150)), "fi", "one")]
    run = lambda rows: {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    got = run(hot + few + one)
    assert all(got[i]["kept"] for i in [*range(320), 330]) and not got[320]["kept"] and not got[331]["kept"]
    alone = run(few)
    assert all(got[i]["distance2"] == alone[i]["distance2"] and got[i]["kept"] == alone[i]["kept"] for i in alone)


@pytest.mark.parametrize("run", [pieces.encode_documents, tokencount.count_tokens, pii.annotate, jpeg.report, quality.judge, quality.keep_quality])
def test_empty_tables(spark, run):
    out = run(docs(spark, []))
    assert out.count() == 0 and out.columns


def test_clashing_columns_are_passed_on(spark):
    df = docs(spark, ["one two three four five six seven eight nine ten eleven", None], extra=True)
    assert pieces.encode_documents(df).where("doc_id = 0").head()["size"] == 1
    assert tokencount.count_tokens(df).where("doc_id = 0").head()["kept"] == 4
    assert quality.keep_quality(df).columns == df.columns
