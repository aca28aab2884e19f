import base64
import hashlib
import itertools
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest

from lexmine.llm import bpe, langid, secrets
from lexmine.llm.common import held
from lexmine.llm.licenses import LEAST, TEMPLATES, anchors, known, scan, templates, window_plan
from lexmine.llm.pii import Finder, iban_valid, luhn, pii_digest
from lexmine.llm.secrets import secrets_digest
from lexmine.llm.spans import Reach
from tests.llm.frames import columns, documents, edge_docs, edge_rows, empty_docs

# --- personal data ---


def test_added_spans_against_every_base_span():
    """What base spans cover, or an earlier span of the kind overlaps, is left out: against tests of all pairs."""
    rng = random.Random(4)

    def spans(n, kinds):
        return [(rng.choice(kinds), a, a + rng.randrange(1, 12), False) for a in (rng.randrange(200) for _ in range(n))]

    for _ in range(300):
        base, added = spans(rng.randrange(25), "xyz"), spans(rng.randrange(25), "uv")
        wanted = []
        for kind, a, b, rule in sorted(set(added), key=lambda s: (s[1], s[0], -s[2])):
            covered = any(s[1] <= a and b <= s[2] for s in base)
            if not covered and not any(s[0] == kind and s[2] > a for s in wanted):
                wanted.append((kind, a, b, rule))
        assert Finder._uncovered(added, base) == wanted
        reach = Reach((s[1], s[2]) for s in base)
        for _, a, b, _ in added:
            assert (reach.before(b) > a) == any(s[1] < b and a < s[2] for s in base)


def test_a_text_with_very_many_spans():
    text = " ".join(f"u{i}@host{i}.org https://me:pw@site{i}/p" for i in range(50_000))
    found = Finder()(text)
    assert sum(s[3] for s in found) == 50_000 and sum(s[0] == "url" for s in found) == 50_000


def pii_base(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    rng, finder = random.Random(3), Finder()
    pools = ["a@.b-", "12@a.+ %", "0123456789. -", "4 -+()1.2", "a1@x.y@z.w.@", "+1 (5)5-", "٣4é@."]
    for _ in range(20000):
        pool = rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert sorted(s[:3] for s in finder(text) if s[3]) == sorted(pii_base(text)), text


def test_added_spans_are_valid_ones():
    finder = Finder()
    added = lambda t: [(k, t[a:b]) for k, a, b, base in finder(t) if not base]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 THE END") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE89 3704 0044 0532 0130 01") == [] and iban_valid("GB82WEST12345698765432")
    assert added("her ssn is 123-45-6789") == [] and added("SSN no. 123-45-6789.") == [("ssn", "123-45-6789")]
    assert added("ssn 666-45-6789") == [] and added("account no. 12345678") == [("account", "12345678")]
    assert added("see https://bob:pw@host.com/x") == [("url", "https://bob:pw@host.com/x")]
    assert added("of no account. In 1999, the konto of compte") == [] and added("https://host.com/a") == []


def test_pii_of_documents_and_edge_rows(spark):
    for docs in (documents(spark), edge_docs(spark)):
        rows = {}
        for r in columns(pii_digest(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"):
            rows.setdefault(r[0], []).append(r)
        for doc, text in columns(docs, "doc_id", "text"):
            base = pii_base(text)
            told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            counts = tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
            assert (doc, *counts, hashlib.sha256(told.encode()).hexdigest()) in [r[:6] for r in rows[doc]]
    assert pii_digest(empty_docs(spark)).count() == 0


# --- secrets ---


def secrets_base(text):
    out = []
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [t for _, _, t in sorted(out)]


def test_base_secrets_against_the_patterns():
    rng = random.Random(5)
    parts = ["token", "PassWord", "passwd", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", "\"", "'", "abc", "AKIA", "ABCD1234", "0a1b2c3d", "é", ".", "\n"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        found = sorted((a, secrets.KINDS.index(k), f"{k}:{a}:{b}") for k, a, b, _ in secrets.base_spans(text))
        assert [t for _, _, t in found] == secrets_base(text), text


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 6, 5)
        score = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
        move = rng.normal(size=(4, 3)).astype(np.float32)
        tags, at = secrets.viterbi(score, counts, move), 0
        for n in counts:
            if n:
                best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: move[3][p[0]] + sum(
                    score[at + i][s] for i, s in enumerate(p)) + sum(move[a][b] for a, b in zip(p, p[1:])))
                assert tuple(tags[at:at + n]) == best
            at += n


def test_field_finds_held_out_secrets_and_little_else(spark):
    rows = [t for _, t in columns(documents(spark, "0.01"), "doc_id", "text") if t]
    marked = [t for t in rows if secrets_base(t)]
    plain = [t for t in rows if not secrets_base(t)]
    field = secrets.fit([t[:3000] for t in marked[::2]] + [t[:600] for t in plain[:200]])
    wrong = sum(len(s) for s in secrets.tagged_spans(plain[200:], field))
    found = [any(secrets.tagged_spans([t], field)[0]) for t in marked[1::2]]
    assert wrong <= 3 and np.mean(found) >= 0.8
    assert secrets.fit(["no secret here"]) is None


def test_secrets_of_documents_and_edge_rows(spark):
    for docs in (documents(spark, "0.01"), edge_docs(spark)):
        told = columns(secrets_digest(docs), "doc_id", "base_sha256", "spans")
        wanted = [(doc, hashlib.sha256(",".join(secrets_base(text or "")).encode()).hexdigest()) for doc, text in columns(docs, "doc_id", "text")]
        assert sorted((r[:2] for r in told), key=str) == sorted(wanted, key=str)
    assert secrets_digest(empty_docs(spark)).count() == 0


# --- languages ---


def phrases(text, reference):
    count = at = 0
    while at < len(text):
        end = at + 1
        if text[at:end] in reference:
            while end < len(text) and text[at:end + 1] in reference:
                end += 1
        count, at = count + 1, end
    return count


@pytest.mark.parametrize("block", [1, 5, 256])
def test_phrases_against_plain_search(monkeypatch, block):
    """Whole texts are parsed in one piece, whatever the blocks; runs of a letter keep blocks from agreeing early."""
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(block)
    sample = {"a": ["the cat sat on the mat", "a dog ran " + "e" * 37], "b": ["ein hund lief, die katze saß"], "c": ["日本語の文章"]}
    model = langid.Model(sample)
    several = ["the hund saß on ßßß mat", "", "  12 ", "日本 cat", "x" * 700, "die katze " * 100, "e" * 3001, "t" + "e" * 900 + "the"]
    several += ["".join(rng.choice("the catsdi nßlf") for _ in range(rng.randrange(2000))) for _ in range(20)]
    counts, lengths = model.phrases(several)
    spelt = lambda texts: bytes(model.spelt(texts)[0])
    for k, lang in enumerate(model.langs):
        assert counts[k].tolist() == [phrases(spelt([t]), spelt(sample[lang])) for t in several]
    assert lengths.tolist() == [len(spelt([t])) for t in several]


def test_a_language_has_columns_for_its_own_letters_only():
    sample = {"a": ["the cat sat on the mat"], "b": ["".join(map(chr, range(0x4E00, 0x4E00 + 150)))]}
    alone, both = langid.Model({"a": sample["a"]}), langid.Model(sample)
    assert both.tables[0].tolist() == alone.tables[0].tolist()
    several = ["the cat", "hat \u4e05\u4e06 mat", "\u4e05\u4e06\u4e07", "zzz", ""]
    spelt = lambda texts: bytes(both.spelt(texts)[0])
    assert both.phrases(several)[0][0].tolist() == [phrases(spelt([t]), spelt(sample["a"])) for t in several]


def test_a_worker_holds_one_model():
    """A model, or a vocabulary, of another sample or operator is made once the one before is gone."""
    ranks = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256))
    samples = [(("a", ("the cat",)),), (("a", ("die katze",)),)]
    makers = [lambda: held(langid._model, samples[0]), lambda: held(langid._model, samples[1]), lambda: bpe._codec(ranks, "."), lambda: held(langid._model, samples[0])]
    for make, other in zip(makers, makers[1:]):
        first = make()
        assert make() is first
        gone = weakref.ref(first)
        del first
        other()
        assert gone() is None
    seen = weakref.ref(held(langid._model, samples[0]))
    assert held(lambda: [seen()]) == [None]


def test_texts_are_parsed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(langid, "BYTES_AT_ONCE", 6)
    texts = ["aaaa", None, "bb", "c" * 30, "", "dd"]
    assert [p.to_pylist() for p in langid._pieces(pa.array(texts))] == [texts[:3], texts[3:4], texts[4:]]
    assert [p.to_pylist() for p in langid._pieces(pa.array(["x", *texts]).slice(1))] == [texts[:3], texts[3:4], texts[4:]]
    assert [len(p) for p in langid._pieces(pa.array([None] * 9, pa.string()))] == [9] and not list(langid._pieces(pa.array([], pa.string())))
    monkeypatch.undo()
    sample = {"a": ["the cat sat on the mat"], "b": ["die katze lief"]}
    rows = spark.range(0, 24, 1, 2).selectExpr("id", "CASE WHEN id % 5 = 1 THEN NULL WHEN id % 2 = 0 THEN repeat('the cat ', 40000) ELSE repeat('katze lief ', 30000) END AS text")
    found = dict(columns(rows.select("id", langid.identify(rows, sample)["lang_pred"].alias("lang_pred")), "id", "lang_pred"))
    assert found == {i: "und" if i % 5 == 1 else "b" if i % 2 else "a" for i in range(24)}


def test_samples_are_windows_of_whole_texts(spark):
    texts = [f"opening words {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 60} closing {i}" for i in range(40)] + ["short", None]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    found = langid.fit(docs, texts=100, chars=20)["en"]
    assert len(found) == 41 and "short" in found and all(any(f in t for t in texts if t) for f in found)
    assert sum(f.startswith("opening words") for f in found) < 10
    assert langid.fit(docs.repartition(1), texts=100, chars=20)["en"] == found


def test_languages_of_held_out_documents(spark):
    docs = documents(spark, "0.01")
    found = {r[0]: r[1:] for r in columns(langid.identify_documents(docs), "doc_id", "held_out", "lang_pred", "score")}
    right = [found[d][1] == lang for d, lang in columns(docs, "doc_id", "lang") if found[d][0] and lang]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(0 <= s <= 1 for _, _, s in found.values())


def test_languages_of_edge_rows(spark):
    found = columns(langid.identify_documents(edge_docs(spark)), "doc_id", "held_out", "lang_pred", "score")
    assert len(found) == len(edge_rows())
    assert {r[0]: r[2] for r in found if r[0] in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert langid.identify_documents(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r[2] for r in columns(langid.identify_documents(unlabelled), "doc_id", "held_out", "lang_pred")} == {"und"}


# --- licences ---


def licenses_wanted(rows, texts):
    out = {}
    for windows in window_plan(templates(texts)):
        span = windows.size - 4
        for doc, text in rows:
            words = re.findall("[a-z0-9]+", (text or "").lower())
            held = [" ".join(words[i:i + 5]) for i in range(len(words) - 4)]
            for t in windows.templates:
                wanted = set(t.shingles)
                for at in range(0, len(held), windows.step):
                    share = len(wanted & set(held[at:at + span])) / len(wanted)
                    if share >= LEAST and share > out.get((doc, t.license, t.number), (0, 0))[0]:
                        out[doc, t.license, t.number] = (share, at + 1)
    return sorted((*k, at, share) for k, (share, at) in out.items())


def test_licences_against_all_windows(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] < 6]
    for k, (_, text) in enumerate(TEMPLATES * 3):
        words = text.split()
        if k >= len(TEMPLATES):  # one word in, or one out
            at = rng.randrange(len(words))
            words[at:at + (k >= 2 * len(TEMPLATES))] = ["odd"]
        rows.append((100 + k, f"{filler(rng.randrange(80))} {' '.join(words).upper() if k % 2 else ' ## '.join(words)} {filler(rng.randrange(80))}"))
    rows += [(300 + k, filler(200) + " license software copyright") for k in range(5)]
    found = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == licenses_wanted(rows, TEMPLATES)


def test_every_match_has_an_anchor():
    found = templates(TEMPLATES)
    words = anchors(found)
    for t in found:
        without = [s for s in t.shingles if not any(w in s.split(" ") for w in words)]
        assert len(without) < LEAST * len(t.shingles)
    with pytest.raises(ValueError):
        templates([("X", "too short")])


def test_licences_of_edge_rows(spark):
    assert scan(edge_docs(spark)).count() == 0 and scan(empty_docs(spark)).count() == 0


def test_licences_that_share_wording(spark):
    notice = lambda name, version, a=":", b=",": (
        f"This program is free software{a} you can redistribute it and/or modify it under the terms of the GNU {name}General Public "
        f"License as published by the Free Software Foundation{b} either version {version} of the License, or any later one.")
    gpl2, gpl3, lgpl, agpl = notice("", "2", ";", ";"), notice("", "3"), notice("Lesser ", "2.1"), notice("Affero ", "3")
    whole = {n: t for n, t in known() if len(t) > 5000}
    wanted = {
        gpl2: {"GPL-2.0"}, gpl3: {"GPL-3.0"}, lgpl: {"LGPL-2.1"}, agpl: {"AGPL-3.0"}, f"{gpl2} {gpl3}": {"GPL-2.0", "GPL-3.0"},
        f"{lgpl} {gpl2}": {"LGPL-2.1", "GPL-2.0"}, "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "Licensed under CC BY 4.0": {"CC-BY-4.0"}, "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        whole["GPL-2.0"]: {"GPL-2.0"}, whole["MPL-2.0"]: {"MPL-2.0"}, whole["LGPL-2.1"]: {"LGPL-2.1"},
        **{next(t for n, t in reversed(known()) if n == name): {name} for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "MIT-0", "0BSD", "ISC", "EPL-2.0")},
    }
    rows = [(k, f"some words before {text} and some after") for k, text in enumerate(wanted)]
    short = "This work is licensed under the GNU General Public License, version 3."
    rows += [(100 + k, "word " * k + short) for k in range(16)] + [(120, short.replace("3", "x"))]
    found = {k: set() for k, _ in rows}
    for k, name in columns(scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "license"):
        found[k].add(name)
    assert list(found.values()) == [*wanted.values(), *[{"GPL-3.0"}] * 17]
