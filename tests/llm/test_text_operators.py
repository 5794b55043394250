"""PII, language, rules, chat and BPE against plain statements of the same, on data and on edge cases."""

import hashlib
import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bpe, chat, langid, pii, rules
from tickloom.llm.queries import op2_pii, op7_langid, op8_rules, op9_chat, op10_bpe, trusted_ids
from tickloom.session import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|>x<|endoftext|>", "é́ 😀😀　x", "a" * 50_000, "x y " * 3000, "\x00\x1c\x85 b", "mail a@b.co, +1 (017) 555-7713"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, base int"


def odd(spark):
    """Odd texts, repeated rows, null ids and columns whose names clash with the results'."""
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", 1) for i, t in enumerate(ODD)] + [(3, "\n\n", None, "s", 1, "x", 1), (None, "no id", "en", "s", 1, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_bpe_query_equals_the_library(spark, texts, reference):
    for r in op10_bpe(spark, SF).collect():
        ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(reference.decode(ids, skip_special_tokens=False))


def test_bpe_odd_texts(spark, reference):
    docs = odd(spark)
    got = bpe.encode(docs, PATH).collect()
    assert sorted(map(str, ([list(r.ids)] for r in got))) == sorted(str([reference.encode(t or "", add_special_tokens=False).ids]) for t in (r.text for r in docs.collect()))
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_bpe_any_text(text):
    codec = bpe.codec(PATH)
    ref = Tokenizer.from_file(PATH) if not hasattr(test_bpe_any_text, "ref") else test_bpe_any_text.ref
    test_bpe_any_text.ref = ref
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for part in next(codec.encode_batch([text])) for i in part]
    assert ids == ref.encode(text, add_special_tokens=False).ids and codec.decode(ids) == text


def test_bpe_slices_of_a_long_text(monkeypatch, reference):
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "CHARS", 20)
    text = "Some words, it's 12 of them   and\n\nmore é <|endoftext|> 😀 end " * 4
    parts = list(next(bpe.PairIndexBPE(PATH).encode_batch([text])))
    assert len(parts) > 5 and [i for p in parts for i in p] == reference.encode(text, add_special_tokens=False).ids


def plain_pii(text):
    """The contract's patterns as written."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[::-1][::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii_query_keeps_the_base_spans(spark, texts):
    for r in op2_pii(spark, SF).collect():
        base = plain_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == pii.digest_of(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+-_ ()%4٣é", max_size=60))
def test_pii_base_equals_the_patterns(text):
    assert [(pii.BASE[k], a, b) for a, k, b in pii.base_spans(text)] == plain_pii(text)


def test_pii_long_runs_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "." * 400_000, "a@" * 200_000, "A1" * 200_000):
        pii.candidates(text, pii.base_spans(text))


def test_pii_many_matches_are_not_quadratic():
    text = "".join(f"{i % 1000:03d}-45-{6000 + i % 3000} " for i in range(40_000))
    began = time.perf_counter()
    found = pii.candidates(text, pii.base_spans(text))
    assert len(found) == 40_000 and time.perf_counter() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1@.+- ()B", max_size=80))
def test_pii_candidates_equal_a_plain_search(text):
    base = pii.base_spans(text)
    taken, want = [(a, b) for a, _, b in base], []
    for k, kind in enumerate(pii.KINDS):
        for m in pii.WIDE[kind].finditer(text):
            a, b = m.span()
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                want.append((a, k, b))
    assert pii.candidates(text, base) == sorted(want)


def test_pii_adds_what_the_labelers_agree_on(spark):
    good = [(i, f"Words and more. My token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" is here", "en") for i in range(40)]
    bad = [(100 + i, f"The build page {i:03d}-45-6789_x of version thing", "en") for i in range(40)]
    rows = pii.find(spark.createDataFrame(good + bad, "doc_id long, text string, spans string")).collect()
    by = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert all(by[i] == ["secret"] for i in range(40)) and not any(by[100 + i] for i in range(40))


def test_pii_em_ranks_reliable_labelers():
    rows = [(0, (1, 1, 1, 0), 100), (0, (1, 1, 0, 0), 50), (0, (-1, -1, 0, 0), 90), (0, (-1, -1, 1, 0), 5), (0, (1, -1, 0, -1), 20)]
    table_, prior, p = pii.expectation_maximisation(rows)
    assert p[0] > 0.9 and p[2] < 0.1 and table_[1][1][2] > table_[1][0][2]


def test_pii_odd(spark):
    rows = pii.find(odd(spark)).collect()
    assert len(rows) == len(ODD) + 2 and pii.find(odd(spark).limit(0)).count() == 0
    assert {s.kind for r in rows for s in r.base} == {"email", "phone"}


def plain_rules(text):
    words = [m for m in re.findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x0b\x85", max_size=80))
def test_rules_counts(text):
    assert rules.counts(text) == plain_rules(text)


def plain_verdict(text, limits):
    """`kept` for a text that passes the base rules, stated anew."""

    def beyond(raw):
        log, at = math.log(len(zstandard.compress(raw, 3)) / len(raw)), math.log2(len(raw))
        line = sorted(limits.line)
        if at <= line[0][0] or at >= line[-1][0]:
            middle = line[0][1] if at <= line[0][0] else line[-1][1]
        else:
            (x0, y0), (x1, y1) = next((p, q) for p, q in itertools.pairwise(line) if p[0] <= at <= q[0])
            middle = y0 + (y1 - y0) * (at - x0) / (x1 - x0)
        low, high = {o: (a, b) for o, a, b in limits.octaves}[min((abs(o - math.floor(at)), o) for o, _, _ in limits.octaves)[1]]
        return log - middle < low or log - middle > high

    raw = text.encode()
    parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)] if len(raw) > 2048 else []
    return not beyond(raw) and sum(len(p) for p in parts if beyond(p)) <= 0.25 * len(raw)


def test_rules_query(spark, texts):
    limits = rules.learn(table(spark, SF, "documents"), trusted_ids(spark, SF))
    for r in op8_rules(spark, SF).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and plain_verdict(text, limits))


def test_rules_reject_unseen_bad_text_and_keep_unseen_good_text(spark):
    """Limits from half of the good documents, held against the other half and all bad ones that pass the base rules."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = trusted_ids(spark, sf).where("doc_id % 2 = 0")
    got = rules.apply_rules(docs, rules.learn(docs, half)).where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic != 1 and r.doc_id % 2]
    bad = [r.kept for r in got if r.quality == 0]
    assert len(good) > 1000 and sum(good) > 0.98 * len(good) and len(bad) > 200 and sum(bad) < 0.5 * len(bad)


def test_rules_judge_the_tail_and_do_without_trusted_text(spark):
    docs = table(spark, SF, "documents")
    limits = rules.learn(docs, trusted_ids(spark, SF))
    good = max((r.text for r in docs.join(trusted_ids(spark, SF), "doc_id").collect()), key=len)[:2000]
    frame = spark.createDataFrame([(1, good), (2, good + " " * (2048 - len(good.encode())) + "x" * 1000)], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.apply_rules(frame, limits).collect()}
    assert got[1].kept and not got[2].kept and got[2].bad_chunks > 0.3
    none = trusted_ids(spark, SF).limit(0)
    assert rules.learn(docs, none) == rules.PRIOR == rules.learn(docs.limit(0), none)


def test_rules_reject_repetition_and_noise(spark):
    import random

    rng = random.Random(1)
    noise = "".join(rng.choice([chr(c) for c in range(33, 0x2000)]) + " " * (i % 7 == 0) for i in range(6000))
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame([(1, "word salad " * 400), (2, noise)], "doc_id long, text string")).collect()}
    assert not got[1].kept and not got[2].kept
    assert rules.apply_rules(odd(spark)).count() == len(ODD) + 2 and rules.apply_rules(odd(spark).limit(0)).count() == 0


def test_rules_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v), int(n)) for g, v, n in zip(rng.integers(0, 3, 900), rng.normal(size=900).round(2), rng.integers(1, 9, 900), strict=True)] + [(7, -1.5, 1)]
    got = rules.quantiles(spark.createDataFrame(rows, "g long, v double, n long"), "g", "v", "n", (0.002, 0.5, 0.998))
    for g in (0, 1, 2, 7):
        plain = np.repeat([v for h, v, _ in rows if h == g], [n for h, _, n in rows if h == g])
        assert got[g][0] == len(plain) and np.allclose(got[g][1:], np.quantile(plain, (0.002, 0.5, 0.998)), rtol=0, atol=1e-12)


def test_rules_learn_from_all_trusted_text(spark):
    """More trusted texts than limits were once learnt from; limits stated anew from the pieces of all of them."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    texts = [" ".join(words[rng.integers(0, 400, 400 + i if i % 400 == 0 else 55 + i % 60)]) for i in range(24_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    limits = rules.learn(frame, frame.select("doc_id").union(frame.select("doc_id").limit(9)))
    raws = [p for raw in map(str.encode, texts) for p in (raw, *([raw[i : i + 2048] for i in range(0, len(raw), 2048)] if len(raw) > 2048 else []))]
    size, log = np.log2([len(r) for r in raws]), np.log([len(zstandard.compress(r, 3)) / len(r) for r in raws])
    medians = [(int((at := np.floor(2 * size) == h).sum()), np.median(size[at]), np.median(log[at])) for h in np.unique(np.floor(2 * size))]
    far = log - np.interp(size, *zip(*sorted(m[1:] for m in medians if m[0] >= 8), strict=True))
    octaves = [(int(o), int((at := np.floor(size) == o).sum()), *np.quantile(far[at], (0.002, 0.998))) for o in np.unique(np.floor(size))]
    plain = rules.limits_from(medians, octaves)
    assert sum(m[0] for m in medians) > 24_000 and [o for o, _, _ in limits.octaves] == [o for o, _, _ in plain.octaves]
    assert np.allclose(limits.line, plain.line, rtol=0, atol=1e-12) and np.allclose(limits.octaves, plain.octaves, rtol=0, atol=1e-12)


def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = [r for r in op7_langid(spark, sf).collect() if r.held_out]
    hit = sum(r.lang_pred == lang[r.doc_id] for r in rows)
    assert len(rows) > 150 and hit / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_viterbi_equals_brute_force():
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(0, 6) for _ in range(4)]
        doc = np.repeat(np.arange(4), sizes)
        scores = np.array([[rng.uniform(-3, 0) for _ in range(3)] for _ in doc]).reshape(-1, 3)
        got = langid.viterbi(scores, doc, 4, 1.0)
        for d in range(4):
            s = scores[doc == d]
            value = lambda path: sum(s[i][x] for i, x in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
            if len(s):
                best = max(itertools.product(range(3), repeat=len(s)), key=value)
                assert value(tuple(got[doc == d])) == pytest.approx(value(best))


def test_langid_spans_of_mixed_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs)
    one = {r.lang: r.text for r in docs.where("n_chars between 300 and 600").collect()}
    mixed = spark.createDataFrame([(1, one["de"] + "\n" + one["fr"])], "doc_id long, text string")
    got = langid.spans(mixed, model).orderBy("seq").collect()
    assert [r.lang for r in got] == ["de", "fr"]


def test_langid_odd(spark):
    docs = odd(spark)
    model = langid.learn(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(ODD) + 2 and {r.lang_pred for r in got} == {"en", "und"}
    none = langid.predict(docs, langid.learn(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, chat.E, "0", "1", "<", "|", "[", "x", "</"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in op9_chat(spark, SF).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(x[1:] for x in rows if x[0] == conv)
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t or ''}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_chat_masks_and_offsets(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (None, None, None, None), (1, 1, "assistant", "yes")]
    encoded = chat.encode_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH)
    chunks = chat.assemble(encoded).collect()
    one = sorted((c for c in chunks if c.conv_id == 1), key=lambda c: c.seq)
    assert [c.start for c in one] == [0, len(one[0].ids), len(one[0].ids) + len(one[1].ids)]
    tok, mark = chat.coder(PATH)
    assert not any(one[0].mask) and tok.decode([i for i, m in zip(one[1].ids, one[1].mask, strict=True) if m]) == "yes"
    assert all(i in mark.values() or i < tok.get_vocab_size() for c in chunks for i in c.ids) and len(chunks) == 4
    assert chat.read_back(chat.assemble(encoded.limit(0)), PATH).count() == 0


@pytest.mark.parametrize("size", [512, 513, 1600, 20_000])
def test_secrets_are_proposed_at_any_length(size):
    token = ("aB3dE6gH9jK2mN5pQ8sT/" * (size // 20 + 1))[:size]
    text = f"api_key: {token}== end"
    assert (9, pii.KINDS.index("secret"), 11 + size) in pii.candidates(text, [])


def test_chat_odd_rows_ties_and_paths(spark):
    """Different texts at one turn, a very long text, nulls, repeated rows and clashing columns, on both ways to read."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "user", "first"), (2, 0, "assistant", "long words " * 40_000), (3, 0, None, None), (3, 0, None, None), (None, 5, "assistant", "ä␛<s>"), (4, 0, "assistant", "")]
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, ids string, chars int, loss boolean")
    got = {r.conv_id: r for r in chat.format_and_read(frame, PATH).collect()}
    assert got == {r.conv_id: r for r in chat.read_back(chat.assemble(chat.encode_rows(frame, PATH)), PATH).collect()}
    for conv in (1, 2, 3, None, 4):
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat.format_and_read(frame.limit(0), PATH).count() == 0
