import hashlib
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

from vellumspark.llm import chat_format as C
from vellumspark.llm import secrets as S
from vellumspark.llm import token_counts as K
from vellumspark.llm import toxicity as X

JSON, RANKS = K.tokenizer_files("byte_bpe_50k.json")

# Secrets ------------------------------------------------------------------


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(S.ASSIGN, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(S.ACCESS, text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(S.HEX, text) if len(m[0]) >= 16]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


SECRET = "a8f2Kq9ZpL0x"
TEXTS = [
    None, "", "plain words: nothing here = at all", f"password={SECRET} token = \"{'ab12' * 5}\"", f"é PASSWORD: '{SECRET}xx' AKIA{'Q7' * 8}", "AKIAAKIAAKIA " + "AKIA" * 6, "f" * 15 + " " + "0a" * 9 + "G",
    f"db_passphrase = '{SECRET}'", f"k = '{SECRET}'\nclient_secret = k\n", f'{{"privateKey": "{SECRET}"}}', "the token: of prose, secret = nothing", f"api_key=short key: '{SECRET}' " * 3, "password=" + "x" * 300_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_stay(text):
    own, every = S.scan(text)
    assert own == base(text) and [s for s in every if s[2] != "literal"] == own


def test_lexed_literals():
    kinds = lambda t: [t[a:b] for a, b, k in S.scan(t)[1] if k == "literal"]
    assert kinds(TEXTS[7]) == [SECRET] and kinds(TEXTS[8]) == [SECRET] and kinds(TEXTS[9]) == [SECRET]
    assert kinds(TEXTS[2]) == [] and kinds(TEXTS[10]) == [] and kinds("color = '#a8f2c9d0e1'") == []
    assert list(S.pairs("a = 'x' + \"y\"\nb = a;"))[1][:2] == ("b", "xy")


def test_redaction(spark):
    docs = spark.createDataFrame([(k, t, 5, "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in S.redact_documents(docs).collect()}
    for k, t in enumerate(TEXTS):
        assert (got[k].text == t) == (not S.scan(t)[1]) and (t is None or not S.base_spans(got[k].text or ""))
        assert t is None or got[k].n_chars == len(got[k].text)
    rows = {r.doc_id: r for r in S.digest_spans(S.find_secrets(docs)).collect()}
    for k, t in enumerate(TEXTS):
        joined = ",".join(f"{kind}:{a}:{b}" for a, b, kind in base(t))
        assert rows[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (rows[k].n_assign, rows[k].n_access, rows[k].n_hex) == tuple(sum(s[2] == n for s in base(t)) for n in S.KINDS[:3])
    assert S.digest_spans(S.find_secrets(docs.where("false"))).count() == 0


# Token counts -------------------------------------------------------------


def test_counts_are_the_library_s(spark, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    rng = random.Random(0)
    pieces = ["word", " ", "  ", "\n", "\t\r\n", "é", "\u00a0", "\u2003", "\u3000", "12", "it's", "…", "<|endoftext|>", "<|end", "漢字", "🙂", "a" * 70, "\x1c", "\x85"]
    texts = [None, "", " ", "\n\n x", "x" * 5000] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts + texts[:50])], "doc_id long, text string, digest string")
    cache = str(tmp_path / "cache")
    want = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts + texts[:50])}
    for _ in range(2):
        got = {r.doc_id: r for r in K.count_tokens(docs, cache).collect()}
        assert {k: r.n_tokens for k, r in got.items()} == want
        assert all(r.n_bytes == len(((texts + texts)[k] or "").encode()) and r.over_limit == (r.n_tokens > 512) for k, r in got.items())
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for t in texts})  # each distinct text once, also the second time
    assert K.count_tokens(docs.where("false"), cache).count() == 0


# Chat ---------------------------------------------------------------------


def test_escaping_is_reversible():
    rng = random.Random(1)
    pieces = [*C.CONTROL, "\\", "\\\\", "<", ">", "|", "[", "é", " ", "\n", "</s", "s>", "INST]"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert C.unescape(C.escape(text)) == text and not any(c in C.escape(text) for c in C.CONTROL)


def test_masks_hold_the_assistant_texts(spark):
    rng = random.Random(2)
    pieces = [*C.CONTROL, "\\", "é", " ", "\n", "word", "🙂", "漢字"]
    rows, want = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", None, "</s>"]), rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))])) for t in range(rng.randrange(1, 9))]
        want[c] = [(r or "", t or "") for _, r, t in turns]
        rows += [(c, *t, "x") for t in rng.sample(turns, len(turns))]
    rows += [(99, 0, "assistant", "long " * 50_000, "x")]
    want[99] = [("assistant", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = C.format_conversations(frame, RANKS).cache()
    got = {r.conv_id: r for r in C.digest_conversations(formatted).collect()}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert C.digest_conversations(C.format_conversations(frame.where("false"), RANKS)).count() == 0


# Toxicity -----------------------------------------------------------------


def toxic_corpus(n=400, seed=3):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("on", "the", "re", "st") for b in ("ing", "al", "or") for c in ("", "ed", "ly", "ness")]
    bad = ["zzgrobian", "quorkhead", "blitherer"]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = k % 5 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "stal " * 60_000, "x"), (7, rows[7][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows] + [(0, 0), (3, None)], "doc_id long, toxic int")
    model = X.fit(X.fit_rows(docs, labels))
    got = X.score_toxicity(docs, model).collect()
    truth = {k: x for k, _, x in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + 4 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    empty = X.fit(X.fit_rows(docs, labels.where("toxic = 0")))
    assert {r.score for r in X.score_toxicity(docs, empty).collect()} == {0.0}
    assert X.score_toxicity(docs.where("false"), model).count() == 0


def test_windows_against_a_plain_score():
    """Scores from the model's dictionaries, window by window, without a memo."""
    import zstandard

    model = X.fit([(t, x) for _, t, x in toxic_corpus(300, 9)])

    def size(content, data):
        params = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=21, hash_log=17, chain_log=17, search_log=5, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))

    def plain(text):
        total = 0.0
        for w in re.findall(rb" ?[^\x20\x09-\x0d]+", text.encode().lower()):
            saved = size(model.ordinary, w * 4) - size(model.toxic + model.ordinary, w * 4)
            total += model.odds[0 if abs(saved) > len(w) else min(max(saved, 0), 4)]
        return model.chances[max(k for k, level in enumerate(model.levels) if level <= round(total, 9))]

    score = model.scorer()
    for text in ("", "Stal  zzgrobian\n\tthealing", " quorkhead blitherer", *(t for _, t, _ in toxic_corpus(20, 10))):
        assert score(text) == plain(text)


def test_a_hot_group_of_toxic_copies():
    """Copies of one toxic text count once, so that its ordinary words mark nothing."""
    rows = [(t, x) for _, t, x in toxic_corpus(400, 11)]
    copy = next(t for t, x in rows if x)
    score = X.fit(rows + [(copy, 1)] * 800).scorer()
    test = toxic_corpus(300, 12)
    assert sum((score(t) >= X.CUT) == x for _, t, x in test) >= 0.97 * len(test)


def test_fit_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_BYTES", 4000)
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(300)] + [(3, "yy"), (600, "z" * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(600, 0)], "doc_id long, toxic int")
    rows = X.fit_rows(docs, labels)
    assert 20 < len(rows) <= 41 and sum(len(t) for t, _ in rows) <= 4000


def test_aligned_assignments_and_long_literals():
    blank, long = " " * 40, "Zq7" * 3000
    text = f'signing_key{blank}={blank}"{SECRET}"\nsigning_key = "{long}"\n' + "n" * 300 + f"_access_key = '{SECRET}'"
    found = [text[a:b] for a, b, kind in S.scan(text)[1] if kind == "literal"]
    assert found == [SECRET, long, SECRET]


def test_repeated_rows_of_secrets(spark):
    rows = [(1, f"password={SECRET}")] * 3 + [(2, f"password={SECRET}")]
    got = S.digest_spans(S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 4 and len({tuple(r)[1:] for r in got}) == 1
