"""The operators' own parts against plain versions, without Spark."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import anchor_pii, crf_secrets, golay_dedup, ordinal_quality, perplexity, suffix_dedup, vector_packing, warc_index, winnowing
from chronoweave.llm.tokens import BYTE_CUTS, WORD_CUTS, Encoder

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("name", "cuts", "small"), [("byte_bpe_50k.json", BYTE_CUTS, False), ("word_bpe_49k.json", WORD_CUTS, True)])
def test_cut_encoding_equals_whole_encoding(name, cuts, small):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    ours, rng = Encoder(P.path(name), cuts, small), random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "12", "!", ",", "|", "<|endoftext|>", "ß", "Σ", "́", "W̊", "中", " ", "İ", "'LL", "word,"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ours.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_unaltered_tokenizer(name, kind):
    from tokenizers import Tokenizer

    from chronoweave.llm.tokens import encoder

    whole, ours, rng = Tokenizer.from_file(P.path(name)), encoder(P.path(name), kind), random.Random(21)
    fixed = ["end <|endoftext|> next", "<|endoftext|>", "<|startoftext|><|endoftext|>", "x<|EndOfText|>y", "<|endoftext|", "é\u0301<|startoftext|>\u0301 B"]
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "12", "!", ",", "|", "<|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u0301", "中", "İ", "word,"]
    for text in fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]:
        assert ours.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_cache_generations(monkeypatch):
    monkeypatch.setattr("chronoweave.llm.tokens.CACHE_CUTS", 3)
    e = Encoder(P.path("byte_bpe_50k.json"), BYTE_CUTS)
    fresh = Encoder(P.path("byte_bpe_50k.json"), BYTE_CUTS)
    fresh.cache = {}
    for text in ("one two three four", "two five six", "one one seven", ""):
        ids = e.encode(text).tolist()
        assert ids == e.tokenizer.encode(text, add_special_tokens=False).ids


# -- anchors and secrets ----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and anchor_pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], anchor_pii.KINDS.index(s[0])))


def test_pii_base_equals_patterns():
    rng = random.Random(2)
    parts = [*"aB@.-+ 0123456789()%_é/:", "1.2.3.4", "@x.y", "4111 1111 1111 1111", "+49 (30) 123", "a@b.c@d.e", "999.1.1.1"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert [s for s in anchor_pii.find(t) if s[0] in anchor_pii.BASE] == plain_pii(t), repr(t)


def test_pii_added_kinds_and_redaction():
    t = "IBAN: DE89370400440532013000, account no. 12345678 and http://me:pw@host.example/x"
    assert [(k, t[a:b]) for k, a, b in anchor_pii.find(t)][:2] == [("iban", "DE89370400440532013000"), ("account", "12345678")]
    assert "userinfo" in {k for k, _, _ in anchor_pii.find(t)}
    assert anchor_pii.redacted("mail a@b.co now") == "mail <email> now"
    assert anchor_pii.redacted("é +49 30 1234567 x") == "é <phone> x"
    assert anchor_pii.redacted(None) is None and anchor_pii.redacted("") == ""
    assert anchor_pii.find("9" * 100_000) == [] and anchor_pii.find("@" * 10_000) == []


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secret_base_equals_patterns():
    rng = random.Random(3)
    none = crf_secrets.fit_sequences([], [])
    parts = [*"aB =:.\"'\nſK", "PassWord", "token", "api_key", "API_Key=", "secret", "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef", "xyz12345", "é"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert crf_secrets.find(t, none) == sorted(want, key=lambda s: (s[1], crf_secrets.KINDS.index(s[0]))), repr(t)


def lines(rng, n):
    out = []
    for _ in range(n):
        value = "".join(rng.choice("abcdefXYZ0123456789") for _ in range(rng.randint(12, 30)))
        out.append(rng.choice([f"db password = '{value}' set", f"token: {value}", f"we sold {rng.randint(1, 99)} items in {rng.randint(1900, 2020)} again", "the key to it all"]))
    return out


def test_field_learns_held_out_and_unseen_secrets():
    rng = random.Random(4)

    def made(text):
        found = crf_secrets.hits(text)
        return list(crf_secrets.sequences(text, found, crf_secrets.matches(text, found)))

    train = [s for t in lines(rng, 400) for s in made(t)]
    field = crf_secrets.fit_sequences([r for _, r, _ in train], [t for _, _, t in train])
    right = total = 0
    for t in lines(rng, 200):
        for _, rows, tags in made(t):
            got = crf_secrets.viterbi(field, rows)
            right, total = right + (got == tags).sum(), total + len(tags)
    assert right / total > 0.97


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    field = crf_secrets.Field(rng.normal(size=(50, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    for _ in range(20):
        rows = rng.integers(0, 50, size=(5, 4))
        e = field.emission[rows].sum(axis=1)
        best = max(np.ndindex(*[3] * 5), key=lambda p: field.first[p[0]] + sum(e[i, p[i]] for i in range(5)) + sum(field.transition[p[i], p[i + 1]] for i in range(4)))
        assert crf_secrets.viterbi(field, rows).tolist() == list(best)


def test_every_token_is_tagged():
    rng = np.random.default_rng(6)
    words = ["secret", "the", "auth:", "x", "Key=", "run", "=", "kilo-lima", "ab/cd", "7", "apple.", "\n", "\n\n", " ", "é"]
    for spread in (0.1, 1, 3):
        field = crf_secrets.Field(rng.normal(size=(1 << crf_secrets.HASH_BITS, 3)) * spread + [3 * (spread < 3), 0, 0], rng.normal(size=(3, 3)), rng.normal(size=3))
        texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)] + [""]
        owner, tags = crf_secrets.Tagger(field).tags(texts)
        for i, t in enumerate(texts):
            want = []
            for line in t.split("\n"):
                if tokens := crf_secrets._TOKEN.findall(line):
                    want += crf_secrets.viterbi(field, crf_secrets.slots(tokens, crf_secrets.file_features(t))).tolist()
            assert tags[owner == i].tolist() == want


def test_secrets_far_from_telling_words_are_found():
    emission = np.zeros((1 << crf_secrets.HASH_BITS, 3))
    field = crf_secrets.Field(emission, np.zeros((3, 3)), np.array([1.0, 0, 0]))
    text = "plain words\nand kilolimamik here"
    emission[crf_secrets.slot("wkilolimamik"), crf_secrets.BEGIN] = 50
    assert crf_secrets.hits(text) == [] and crf_secrets.find(text, field) == [("tagged", 16, 27)]


# -- near and exact duplicates ----------------------------------------------------------------


def test_codeword_indices_share_within_two_bits():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 1 << 23, 4000)
    own = golay_dedup.codeword_indices(v)
    assert (own[:, 0] >= 0).all()
    for flips in ((3,), (22,), (0, 7), (11, 12), (5, 21)):
        other = golay_dedup.codeword_indices(v ^ sum(1 << b for b in flips))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(own, other, strict=True))


def test_keys_of_linked_fingerprints_meet():
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    for _ in range(40):
        mask = np.uint64(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
        a, b = golay_dedup.keys_of(f), golay_dedup.keys_of(f ^ mask)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_fingerprint_by_hand():
    import xxhash

    assert golay_dedup.fingerprint(None) == golay_dedup.fingerprint(" \n") == 0
    assert golay_dedup.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    words = "w x y z w x y z q".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(6)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 6)
    assert golay_dedup.fingerprint(" ".join(words)) == want


def test_suffix_array_equals_sorting():
    rng = random.Random(8)
    for k in range(3000):
        n, a = rng.randint(1, 40), rng.choice([1, 2, 3, 8])
        t = [rng.randint(1, a) for _ in range(n)]
        if k % 5 == 0:
            t = (t[: rng.randint(1, 4)] * 20)[:n]
        t.append(0)
        order = suffix_dedup.suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffix_dedup.common_prefixes(t, order)
        for r in range(1, len(t)):
            x, y = t[order[r - 1] :], t[order[r] :]
            assert shared[r] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_anchors_mark_every_window_and_agree():
    rng = np.random.default_rng(9)
    for size in (0, 399, 400, 401, 3000, 140_000):
        data = rng.integers(97, 101, size, dtype=np.uint8).tobytes()
        at, hashes, first, last = suffix_dedup.anchors(data)
        of = {w: (p - w, h) for p, h, a, b in zip(at.tolist(), hashes.tolist(), first.tolist(), last.tolist(), strict=True) for w in range(a, b + 1)}
        assert sorted(of) == list(range(max(0, size - 399)))
        assert all(0 <= p <= suffix_dedup.REACH for p, _ in of.values())
        if size == 3000:  # a window's anchor depends on the window alone
            moved = suffix_dedup.anchors(b"xyz" * 50 + data[500:1500])
            there = {w: (p - w, h) for p, h, a, b in zip(*(x.tolist() for x in moved), strict=True) for w in range(a, b + 1)}
            assert all(there[150 + i] == of[500 + i] for i in range(601))


# -- packing, perplexity, grades, windows -----------------------------------------------------


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_constraint(rule):
    rng = np.random.default_rng(10)
    for cap in (vector_packing.Capacity(rule=rule), vector_packing.Capacity(tokens=100, documents=3, attention=4000, rule=rule)):
        lengths = rng.integers(1, min(cap.tokens, int(cap.attention**0.5)) + 1, 800)
        bins, offsets = vector_packing.place(lengths, cap)
        for b in np.unique(bins):
            mine = bins == b
            assert lengths[mine].sum() <= cap.tokens and mine.sum() <= cap.documents and (lengths[mine] ** 2).sum() <= cap.attention
            order = np.argsort(offsets[mine])
            assert offsets[mine][order].tolist() == [0, *lengths[mine][order].cumsum()[:-1].tolist()]
    assert len(np.unique(vector_packing.place(np.full(10, 512), vector_packing.Capacity(rule=rule))[0])) == 5
    assert vector_packing.place(np.empty(0, np.int64), cap)[0].tolist() == []


def test_cut_lengths():
    assert vector_packing.cut(2049, 1024) == [1, 1024, 1024] and vector_packing.cut(1024, 1024) == [1024] and vector_packing.cut(1, 1024) == [1]


def test_grams_know_their_texts():
    keys, sizes = perplexity.grams(["Ab c", "", "x1\n\n2"])
    assert sizes.tolist() == [4, 0, 4]
    mask = (1 << perplexity.CHAR_BITS) - 1
    assert "".join(chr(k & mask) for k in keys.tolist()) == "ab cx0 0"
    assert keys[4] == ord("x")  # a text starts behind the boundary


def test_base_counts_by_hand():
    for text in ("a b a b a b", "x x x x", "a b c d", "", "l1 #\nl1 #\n\n\nq|", "k" * 50 + " m"):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        assert perplexity.base_counts(text) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(hit))


def test_ordinal_model_separates_held_out_grades():
    rng = random.Random(11)

    def doc(g):
        words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(30)]
        if g == 1:
            words[3] = rng.choice(["badword", "worse"])
        return " ".join(w + "%%%" if g == 0 else w for w in words)

    made = [(g, ordinal_quality.features(doc(g))) for g in (rng.choice([0, 1, 2, 2, 2]) for _ in range(900))]
    model = ordinal_quality.fit_rows([f for _, f in made[:600]], np.array([g for g, _ in made[:600]]), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.weights[f].sum() for _, f in made[600:]]))
    assert ((tails[:, 1] >= 0.8) == [g == 2 for g, _ in made[600:]]).mean() > 0.97
    assert (tails[:, 0] >= tails[:, 1]).all()
    flat = ordinal_quality.fit_rows([], np.empty(0, np.int64), 3)
    assert not flat.weights.any()


def test_winnowing_guarantee():
    rng = random.Random(12)
    for _ in range(300):
        shared = [rng.choice(["p", "q", "r", "s"]).encode() for _ in range(10)]
        a = [b"x%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 8))] + shared
        b = shared + [b"y%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 8))]
        pick = [{int(g[i]) for i in winnowing.selected(g)} for g in (winnowing.gram_hashes(winnowing.word_hashes(w), 5) for w in (a, b))]
        assert pick[0] & pick[1]


def test_warc_record_round_trip_and_keys():
    payload = "<p>é\r\n\r\n</p>".encode()
    import hashlib

    digest = hashlib.sha256(payload).hexdigest()
    got = warc_index.parse(warc_index.record(7, "http://a.b/\nX: y", payload, digest, None))
    assert (got["page_id"], got["payload"], got["record_type"], got["refers_to"], got["payload_digest"]) == (7, payload, "response", None, digest)
    got = warc_index.parse(warc_index.record(-8, None, payload, digest, 7))
    assert (got["page_id"], got["payload_bytes"], got["record_type"], got["refers_to"]) == (-8, len(payload), "revisit", 7)
    assert warc_index.url_key("https://Blog.Example.com:443/en?q=1#x") == "com,example,blog)/en?q=1"
    assert warc_index.url_key("http://h:8080") == "h:8080)/" and warc_index.url_key(None) == ")" and warc_index.url_key("http://[x/") == ")http://[x/"


def test_known_cuts_are_looked_up_once_and_new_ones_learnt_together(monkeypatch):
    import public_tokenizers

    from chronoweave.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CUTS", 6)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), tokens.BYTE_CUTS, added=True)
    learnt, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda cuts: (learnt.append(1), learn(cuts)))
    for text in ("one two two", "one two", "three four five, six seven", "one two", ""):
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(learnt) == 3


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_new_cuts_of_many_texts_are_learnt_in_one_call(name, kind, monkeypatch):
    from tokenizers import Tokenizer

    from chronoweave.llm import tokens

    whole, rng = Tokenizer.from_file(P.path(name)), random.Random(43)
    enc = tokens.Encoder(P.path(name), *{"byte": (BYTE_CUTS, False), "word": (WORD_CUTS, True)}[kind], added=True)
    learnt, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda cuts: (learnt.append(1), learn(cuts)))
    parts = ["a", "bar", "É", " ", " ", "  ", "\n", "\u3000", "'s", "'", "12", "$$$", "&&&", "***", "%%%", "###", " $", "<|endoftext|>", "\u0301", "中", " 中", "\x1c", " \x1c", "don't", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1200)] + ["", " ", " a", "word$$$ word&&& word"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_all(texts)] == want and len(learnt) == 1
    for joined, group, held in ((2, 50, 7), (256, 1, 3)):
        monkeypatch.setattr(tokens, "JOINED_CUTS", joined)
        monkeypatch.setattr(tokens, "GROUP_CHARS", group)
        monkeypatch.setattr(tokens, "CACHE_CUTS", held)
        assert [x.tolist() for x in enc.encode_all(texts)] == want
