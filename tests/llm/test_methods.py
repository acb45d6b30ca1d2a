"""Operators against plain versions of what they must give."""

import hashlib
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from layerlens.llm import common, html, jaccard, licenses, packing, pii, quality, queries, secrets, subwords, toxicity
from layerlens.llm.components import components
from layerlens.llm.dedup import exact_dedup


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


def test_packing_is_whole_and_tight(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = defaultdict(list)
    for r in queries.op1_best_fit_packing(spark, sf).collect():
        got[r.doc_id].append(r)
    sequences = defaultdict(list)
    for i, text in texts.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        for k, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            own = np.array(ids[2048 * k : 2048 * k + 2048], "<u4")
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(own), zlib.crc32(own.tobytes()))
            sequences[r.sequence_id].append((r.offset, r.length))
        assert sum(r.length for r in got[i]) == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= -(-total // 2048) + 1


def test_bounds_hold_and_certify():
    rng = random.Random(4)
    for _ in range(60):
        cap = 100
        items = np.array(sorted((rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 40))), reverse=True))
        _, _, fill = packing.best_fit(items, cap)
        assert fill.sum() == items.sum() and fill.max() <= cap
        assert packing.lower_bound(items, cap) <= len(fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_packing_rounds_exchange(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, 0, 0, rng.randrange(300, 1200), i) for i in range(900)], packing.PIECES)
    out = packing.pack(items, group_tokens=40_000).collect()
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert len(out) == 900 and max(fill.values()) <= 2048
    alone, _, _ = packing.best_fit(np.array(sorted((r.length for r in out), reverse=True)))
    assert len(fill) <= (alone.max() + 1) * 1.03


BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"access": 20, "hex": 24}


def test_secrets_base_and_assignments(spark, sf, texts):
    for r in queries.op2_secret_scan(spark, sf).collect():
        spans = sorted((m.start(), list(BASE).index(k), k, m.end()) for k, p in BASE.items() for m in p.finditer(texts[r.doc_id]) if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= LEAST[k]))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    text = 'base = "hunter2Zq9"\ndb_password = base + "tail!!9"\nnote: value\nPASSWORD=changeme\n'
    found = {text[a:b] for k, a, b in secrets.find_secrets(text)[0] if k == "literal"}
    assert found == {"hunter2Zq9", "tail!!9"}
    assert "hunter2Zq9" not in secrets.redacted(text, secrets.find_secrets(text)[1])


def test_secrets_of_one_class_escapes_and_bare_values():
    def found(text):
        return [text[a:b] for a, b, _ in secrets.assigned_literals(text)]

    assert found('db_pwd = "hunterhunter"') == ["hunterhunter"] and found("credential = '8391048275'") == ["8391048275"]
    assert found('passphrase = "correcthorsebatterystaple"') == ["correcthorsebatterystaple"] and not found('primary_key = "customernumber"')
    assert found(r'db_pwd = "ab\"cd\\12xyz"') == [r'ab\"cd\\12xyz']
    assert found("DB_PWD=p@ssw0rd!xyz\nexport API_TOKEN=$1x!y&z,9(q\n") == ["p@ssw0rd!xyz", "$1x!y&z,9(q"]
    assert found("see db_pwd=p@ssw0rd!xyz, then") == ["p@ssw0rd!xyz"] and found("base = 'hunter2Zq9'\ndb_pwd = base;") == ["hunter2Zq9"]
    text = "password=S3cr3t!tail and on"
    assert secrets.redacted(text, secrets.find_secrets(text)[1]) == "password=[SECRET] and on"


def test_subwords_equal_the_library(texts):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    t, lib, rng = subwords.transducer(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    letters = "abcdehinorst  .,\n\u00e9\ud55c\ufb010123_()"
    for text in [*list(texts.values())[:60], "", " ", "  a  b ", *("".join(rng.choice(letters) for _ in range(30)) for _ in range(1500))]:
        ids = np.frombuffer(t.encode(text), "<u4").tolist()
        assert ids == lib.encode(text)
        assert t.decode(ids) == text


def _near_rows():
    """Families of near copies, a passage that many documents share, and one large family with strays beside it."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        for _ in range(120 if family == 0 else rng.randrange(1, 25)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((k, " ".join(own + (passage if rng.random() < 0.2 else []))))
            k += 1
    for _ in range(40):  # nearly the passage alone
        rows.append((k, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(2, 12))])))
        k += 1
    return rows


def test_jaccard_equals_all_pairs(spark):
    rows = _near_rows()
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, bits=14).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert 1 < len({root(i) for i in sets}) < len(sets)


def test_signatures_never_exceed_the_difference():
    rng = random.Random(1)
    pool = np.array([rng.getrandbits(64) for _ in range(900)], np.uint64)
    for _ in range(200):
        x, y = (np.array(rng.sample(list(pool), rng.randrange(1, 700)), np.uint64) for _ in "xy")
        apart = sum((int(a) ^ int(b)).bit_count() for a, b in zip(jaccard._signature(x).view(np.uint64), jaccard._signature(y).view(np.uint64), strict=True))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_membership_filters_hold_all(spark):
    values = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bitmap = common.membership(values, "h", 17)
    cells = np.array([r.c for r in values.select(common.cell(F.col("h"), 17).alias("c")).collect()], np.int64)
    assert common.may_hold(bitmap, cells).all() and np.unpackbits(bitmap).sum() == len(set(cells.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(31)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sound(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_pii_base(spark, texts):
    odd = ["a@b.c%d@e.f", "..@a.b-c.d..e", "1.2.3.4.5.6.7.8", "999.1.1.1 001.2.3.4", "4111 1111 1111 1111 +49 (30) 123-4567", "\U0001f600 a@b.co é 4111-1111-1111-1111", "+1 2", "4012888888881881 " * 3, "a@" + "b." * 3000 + "c"]
    rows = [*texts.items(), *((100_000 + i, t) for i, t in enumerate(odd))]
    every = dict(rows)
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, every[r.doc_id]) if _sound(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.base] == want


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"Reach Zanzibor Quill at zq@mail.example about the plan number {i} or the weather") for i in range(5)]
    rows += [(10 + i, f"the plan about the weather or a number at hand {i}") for i in range(60)]
    got = {r.doc_id: {s.term for s in r.terms} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == {"reach", "zanzibor", "quill"} and all(not got[10 + i] for i in range(60))
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first().text
    assert "Zanzibor" not in clean and "[EMAIL]" in clean and "weather" in clean


def test_pii_equals_brute_force(spark, sf, texts):
    """Counts, spans, disclosures and generalisations of all documents, from plain sets of documents."""
    n = len(texts)
    terms = {i: set(x.lower() for x in regex.findall(r"\p{L}{3,}", t or "")) for i, t in texts.items()}
    base = {i: [(k, m.start(), m.end(), m[0]) for k, p in PII.items() for m in re.finditer(p, t or "") if _sound(k, m[0])] for i, t in texts.items()}
    df, held = Counter(x for s in terms.values() for x in s), defaultdict(set)
    for i, spans in base.items():
        for k, _, _, v in spans:
            held[k, v].add(i)
    common = Counter()
    for x, c in df.items():
        for k in range(1, min(5, len(x))):
            common[x[:k]] = max(common[x[:k]], c)
    want = {}
    for i, spans in base.items():
        own = {(k, v) for k, _, _, v in spans}
        for x in terms[i]:
            best = 0.0
            for c in own:
                docs = held[c]
                if len(docs) < n:
                    share = df[x] / n
                    both = sum(x in terms[j] for j in docs)
                    best = max(best, min(1.0, math.log2((both + pii.PRIOR * share) / (len(docs) + pii.PRIOR) / share) / math.log2(n / len(docs))) if both else 0.0)
            if best >= pii.GENERALISE:
                most = max(len(held[c]) for c in own if len(held[c]) < n)
                fits = [x[:k] for k in pii.BEGINNINGS if len(x) > k and common[x[:k]] > n ** (1 - pii.GENERALISE) * most**pii.GENERALISE]
                want[i, x] = (round(best, 9), fits[0] if fits else None)
    got = {}
    for r in pii.find_pii(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert [(s.kind, s.start, s.end, s.value) for s in r.base] == base[r.doc_id]
        for s in r.terms:
            assert texts[r.doc_id][s.start : s.end].lower() == s.term
            got[r.doc_id, s.term] = (round(s.disclosure, 9), s.general)
    clear = {(i, x): v for (i, x), v in want.items() if any(m[0].lower() == x and not any(b < m.end() and m.start() < e for _, b, e, _ in base[i]) for m in regex.finditer(r"\p{L}{3,}", texts[i]))}
    assert got == clear and len(got) > 100
    kinds = Counter()
    for r in queries.op5_pii(spark, sf).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        listed = [x for x in spans if x[0] in PII]
        assert spans[: len(listed)] == listed and hashlib.sha256(",".join(map(":".join, listed)).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in listed) for k in PII]
        kinds.update(x[0] for x in spans)
    assert kinds["generalise"] and kinds["remove"]


def test_pii_terms_of_rare_entities(spark):
    rows = [(0, "Zanzibor Quill wrote at zq@mail.example about the weather")]
    rows += [(10 + i, f"the plan about the weather or what one wrote at hand {i}") for i in range(60)]
    got = {r.doc_id: [(s.term, s.start, s.end) for s in r.terms] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == [("zanzibor", 0, 8), ("quill", 9, 14)] and not any(got[10 + i] for i in range(60))


def test_pii_terms_far_and_repeated(spark):
    plain = "the plan about the weather and what one wrote at hand "
    text = "zq@mail.example " + plain * 20 + "Zanzibor " + plain * 3 + "ZANZIBOR zanzibor@mail.example"
    rows = [(i, text) for i in range(4)] + [(10 + i, plain) for i in range(60)]
    got = {r.doc_id: [text[s.start : s.end] for s in r.terms] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["Zanzibor", "ZANZIBOR"] for i in range(4)) and not got[10]
    assert "zanzibor" not in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first().text.lower()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>The &amp; title</h1><p>One  two\nthree, and more.<br><p>Second <b>bold</b> part.</article><div class="comments"><p>Nice.</p></div><footer>&copy; me</footer></body></html>"""


def test_html_pages(spark, sf):
    from html import unescape

    for r, src in zip(queries.op6_html_extraction(spark, sf).orderBy("page_id").collect(), spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*)</article>", src.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_without_a_model(spark):
    got = html.extract(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>bare")], "page_id long, html string")).orderBy("page_id").collect()
    assert [r.main_text for r in got] == ["The & title\n\nOne two three, and more.\n\nSecond bold part.", "", "bare"]


SAID = [
    "The river was calm and the boats lay still along the long quay, as they had for years.", "Nobody in the town could say who had first tied them there, or why the ropes were red.",
    "On the third morning a letter came, and with it the first real news of the season.", "It spoke of storms, of a broken bridge, and of three men who would not be coming home.",
    "The mayor read it twice, folded it, and went out to look at the water again.", "By noon everybody knew, and the market closed an hour early, which was not usual.",
]
STORY = "".join(f"<p>{x} {y}</p>" for x, y in zip(SAID, SAID[1:], strict=False))
MENU = "<div><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Contact us</a></li></ul></div>"
SIDE = "<div><h3>Latest stories</h3><ul><li><a href=1>A new bridge</a></li><li><a href=2>Red ropes sold out</a></li></ul></div>"
TALK = "<div><h3>Reader opinions</h3><div><b>Anna</b><p>I liked this a lot, thanks.</p></div><div><b>Bert</b><p>Not true at all, the ropes were blue.</p></div></div>"
BODY, FOOT = f"<h1>The calm river</h1>{STORY}", "<div>&copy; 2020 The Town Paper</div>"


@pytest.fixture(scope="module")
def trees(spark, sf):
    return html.fit(spark.read.parquet(f"{sf}/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title></head><body>{MENU}{SIDE}<div>{BODY}</div>{TALK}{FOOT}</body></html>",
        f"<html><body><div>{MENU}<div><div>{BODY}</div>{TALK}</div>{SIDE}</div>{FOOT}</body></html>",
        f"<body><nav><a href=x>Home</a></nav><article><header><h1>The calm river</h1></header>{STORY}</article><footer>me</footer>",
        f"<head><title>x</title><meta a=b><body><article>{BODY}</article>",
        f"<html><body><form action=x>{MENU}<div>{BODY}</div>{FOOT}</form></body></html>",
        f"<html><body><div class=navbar>{MENU}</div><div id=content>{BODY}</div><div class=comments>{TALK}</div><div class=sidebar>{SIDE}</div></body></html>",
        BODY,
    ],
)
def test_html_pages_without_meaning(trees, page):
    want = "\n\n".join(["The calm river"] + [f"{x} {y}" for x, y in zip(SAID, SAID[1:], strict=False)])
    p = html.parse(page)
    assert html.main_text(p, html.decode(p.parents, trees.log_odds(html.node_features(p)))) == want


def test_html_text_outside_blocks(trees):
    for page, want in (("Hello world bare text", "Hello world bare text"), ("<span>text here</span><p>second</p>", "text here\n\nsecond")):
        p = html.parse(page)
        assert html.main_text(p, html.decode(p.parents, trees.log_odds(html.node_features(p)))) == want


def test_html_parse_is_linear():
    import time

    began = time.process_time()
    for page in ("<div>" * 40_000 + "x", "<div><a>" * 40_000 + "<p>x" * 4000 + "</q>" * 40_000, "<li>x" * 40_000):
        html.node_features(html.parse(page))
    assert time.process_time() - began < 20


def test_decoding_never_contradicts():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 40)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        score = np.array([rng.uniform(-2, 2) for _ in range(n)])
        keep = html.decode(parents, score)
        assert all(not keep[i] or p < 0 or keep[p] for i, p in enumerate(parents))
        assert score[keep].sum() >= -1e-9


def test_licenses_equal_brute_force(spark, sf, texts):
    warranty = dict(licenses.BODIES)
    odd = {1: "Released under the MIT License", 2: "released, under (the) mit-license", 3: "x " * 100 + "Licensed under the Apache License Version 2.0 " + "y " * 90, 4: "general public license mit license", 5: "all rights reserved", 6: "rights all", 7: None}
    odd |= {10 + k: "z " * (17 * k) + " ".join(x for i, x in enumerate(t.split()) if i % 9 != k % 9) + " end" * k for k, (_, t) in enumerate(licenses.BODIES)}
    odd |= {40: "all rights reserved " * 300, 41: " ".join(warranty.values())}
    rows = [*odd.items(), *((1000 + i, t) for i, t in texts.items())]
    every, templates = dict(rows), licenses.TEMPLATES + licenses.BODIES
    hits = 0
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = licenses.template_words(every[r.doc_id] or "")
        want = set()
        for label, text in templates:
            tokens, stride = set(licenses.template_tokens(text)), licenses.stride_of(text)
            for at in range(0, max(0, len(words) - 1 - stride) + 1, stride):
                block = set(words[at : at + 2 * stride])
                if len(block & tokens) >= licenses.THETA * len(tokens) - 1e-9 and tokens & set(licenses.NAMES) <= block:
                    want.add((label, at, round(len(block & tokens) / len(tokens), 9)))
        assert {(m.label, m.block, round(m.containment, 9)) for m in r.matches} == want
        places = [(i, v) for i in range(len(words)) for p, v in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == sorted({v for _, v in places}) and r.labels == sorted({v for _, v in places} | {m[0] for m in want})
        hits += bool(want)
    assert hits > 15
    for r in queries.op8_license_scan(spark, sf).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_license_names_and_bodies(spark):
    first = lambda label: next(t for x, t in licenses.BODIES if x == label)
    warranty = "x " * 70 + first("mit").upper() + " y" * 70
    rows = [(1, "Released under the Apache License"), (2, "license the parts under which it was released"), (3, "Licensed under the MIT License"), (4, warranty), (5, first("bsd")), (6, first("isc")), (7, first("zlib")), (8, first("unlicense"))]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["apache"], 2: [], 3: ["mit"], 4: ["mit"], 5: ["bsd"], 6: ["isc"], 7: ["zlib"], 8: ["unlicense"]}


def test_licenses_with_many_templates(spark):
    """Hundreds of whole licence texts are rows of an index, not parts of the plan."""
    rng = random.Random(8)
    many = tuple((f"l{k}", " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 300)))) for k in range(300))
    rows = [(k, "a " * (k % 70) + many[k][1] + " b" * (k % 50)) for k in range(0, 300, 10)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=many).collect()}
    assert got == {k: [f"l{k}"] for k in range(0, 300, 10)}


def test_quality_order_never_changes_a_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ranked = quality.cascade_order(docs)
    assert {r.name for r, _, _ in ranked} == {r.name for r in quality.BASE_RULES + quality.METHOD_RULES}
    one = quality.quality_verdicts(docs, order=ranked).where("kept").select("doc_id")
    two = quality.quality_verdicts(docs, order=ranked[::-1], metrics=tuple(quality.MEASURES)).where("kept").select("doc_id")
    assert sorted(one.collect()) == sorted(two.collect())


def test_dedup_checks_bytes_and_batches(spark):
    rows = [(i, f"text {i % 7}" if i % 2 else f"text  {i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: min(j for j in range(40) if j % 7 == i % 7) for i in range(40)}
    sound = exact_dedup(docs, files_per_trigger=1).collect()
    weak = exact_dedup(docs, digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)).collect()
    for got in (sound, weak):
        assert {r.doc_id: r.keep_id for r in got} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)
        assert all(r.group_size == sum(j % 7 == r.doc_id % 7 for j in range(40)) for r in got)


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    unique = p.exact_copies(spark, kept, sf)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in unique.collect()]
    assert len(norm) == len(set(norm)) == kept.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
    apart = p.near_copies(spark, unique, sf)
    label = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(unique).collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(label.values()))
    safe = p.secrets(spark, apart, sf)
    assert safe.count() == apart.count() and safe.columns == docs.columns
    assert all(not secrets.find_secrets(r.text)[1] and r.n_chars >= 0 for r in safe.collect())
    packed = p.packing(spark, safe, sf)
    assert packed.select("doc_id").distinct().count() == safe.count()


def test_toxicity_counts_all_places(spark):
    words = ["die"] * 60 + ["word"] * 5 + ["idiot", "a", "you", "you", "1d1ot", "1d1ot"]
    one = spark.createDataFrame([(" ".join(words),)], "text string").select(toxicity.features(F.col("text"), ["word"], []).alias("f")).first().f
    n = len(words)
    assert (one.nearest_you, one.learned_density, one.second_person_density) == (2, 5 / n, 2 / n)
    assert one.abuse_density == 63 / n and one.abuse_kinds == 3 and one.learned_kinds == 1


def test_quality_cascade_stops_early(spark):
    """A rule behind one that rejects isn't evaluated: here it would fail."""
    docs = spark.createDataFrame([("few",), ("one two three four five six seven eight nine ten eleven twelve a b c d e f g h i",)], "text string")
    fails = quality.Rule("fails", lambda m: F.raise_error(F.lit("evaluated")).cast("boolean") | (m("n_marks") > 0))
    order = [(quality.BASE_RULES[0], 0.0, 0.0), (fails, 0.0, 0.0)]
    assert not quality.quality_verdicts(docs.where("text = 'few'"), order=order, metrics=("n_words",)).first().kept
    with pytest.raises(Exception, match="evaluated"):
        quality.quality_verdicts(docs, order=order, metrics=("n_words",)).collect()


def _message(*fields):
    """A protocol buffer message of (number, bytes | float | int)."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        data = value if isinstance(value, bytes) else None
        rest, varint = len(data) if data is not None else value, b""
        while rest > 127:
            varint, rest = varint + bytes([rest & 127 | 128]), rest >> 7
        out += bytes([number << 3 | (2 if data is not None else 0)]) + varint + bytes([rest]) + (data or b"")
    return out


def _unigram_model(with_bytes):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else [])
    texts = ["\u2581", "a", "b", "c", "d", "ab", "bc", "abc", "\u2581a", "\u2581ab", "cd", "bcd", "dd", "\u2581b", "cab", "\u2581cab"]
    pieces += [(t, -1.5 - 0.37 * ((7 * i) % 11) - 0.01 * i, 1) for i, t in enumerate(texts)] + [("[x]", 0.0, 4)]
    model = b"".join(_message((1, _message((1, t.encode()), (2, float(w)), (3, k)))) for t, w, k in pieces)
    trainer = _message((3, 1)) + (b"\x98\x02\x01" if with_bytes else b"")  # field 35: byte fallback
    return model + _message((2, trainer)) + _message((3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))


@pytest.mark.parametrize("with_bytes", [False, True])
def test_unigram_equals_the_library(with_bytes):
    import sentencepiece

    model = _unigram_model(with_bytes)
    t, lib, rng = subwords.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(6)
    for text in ["", "a", "zz top", "ab\u00e9\u00e9cd", "[x]a[x]", *("".join(rng.choice("abcd z\u00e9\ud55c") for _ in range(rng.randrange(1, 25))) for _ in range(800))]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == lib.encode(text), text


def test_subword_columns(spark, sf, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for r in queries.op3_sentencepiece(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_ids, r.n_fallback) == (len(ids), sum(lib.is_byte(i) for i in ids))
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and r.round_trip == (lib.decode(ids) == texts[r.doc_id])


def _found(text):
    return [text[a:b] for a, b, _ in secrets.assigned_literals(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('private_api_access_signing = "Zq81kkPw02"', ["Zq81kkPw02"]),
        ('base = "hunter2Zq9"\ndb_password=base+"tail!!9"', ["hunter2Zq9", "tail!!9"]),
        ("A=hunter2Zq9\nDB_PASSWORD=$A\nOTHER=1", ["hunter2Zq9"]),
        ('a: hunter2Zq9\ndb_passwd: "${a}"', ["hunter2Zq9"]),
        ('part = "hunter2Zq9"\ndb_password = f"x-{part}!"', ["hunter2Zq9", "x-", "!"]),
        ('db_password = """hunter2Zq9\nsecond line"""', ["hunter2Zq9\nsecond line"]),
        ("<config><db_password>hunter2Zq9</db_password></config>", ["hunter2Zq9"]),
        ('<add key="db_password" value="hunter2Zq9"/>', ["hunter2Zq9"]),
        ('db_password = base\nbase = "hunter2Zq9"', ["hunter2Zq9"]),
        ('note = "db_password = hunter2Zq9"', []),
        ("# db_pwd = 'hunter2Zq9'\n// db_pwd = 'hunter2Zq9'\n/* db_pwd = 'hunter2Zq9' */", []),
        ('def f():\n    x = "hunter2Zq9"\ndef g():\n    db_pwd = x + "abc"\n', []),
        ('x = "hunter2Zq9"\ndef g():\n    db_pwd = x + ""\n', ["hunter2Zq9"]),
        ('function f() { let x = "hunter2Zq9"; }\nfunction g() { db_pwd = x + ""; }', []),
        ('const db_pwd: string = "hunter2Zq9";', ["hunter2Zq9"]),
        ('db_pwd = os.environ["DB_PWD_NAME"]\ndb_pwd2 = getenv("SOMETHING1")', []),
        ("a1 = a2\na2 = a1\nsecret_key = a1", ["a1"][:0]),
        ("it\u2019s and don't use 'db_pwd = x' or won't", []),
    ],
)
def test_secret_lexer(text, want):
    assert _found(text) == want


def test_secret_lexer_on_long_chains():
    n = 3000
    down = "a0 = 'hunter2Zq9'\n" + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(n)) + f"db_password = a{n}"
    up = f"db_password = a{n}\n" + "".join(f"a{i + 1} = a{i} + ''\n" for i in reversed(range(n))) + "a0 = 'hunter2Zq9'\n"
    assert _found(down) == _found(up) == ["hunter2Zq9"]
    assert _found("key = key\n" * 20_000 + "token: abcDEF123") == ["abcDEF123"]


def _plain_features(text, learned, stems):
    """The features by their definitions, word by word."""
    w = regex.findall(r"[\p{L}\p{N}@$!*]*[\p{L}\p{N}]", text.lower())
    n, d, abuse, you = max(1, len(w)), set(w), set(toxicity.ABUSE), set(toxicity.SECOND_PERSON)
    bare = str.maketrans(*toxicity.DISGUISE)
    masked = lambda x: bool(re.search("[0-9@$!]", x)) and x.translate(bare) in abuse
    hidden = {x.translate(bare) for x in d if masked(x)}
    stemmed = [x for x in w if any(x[:k] in stems and len(x) >= k for k in toxicity.STEMS)]
    a, y = [i for i, x in enumerate(w) if x in abuse], [i for i, x in enumerate(w) if x in you]
    letters = max(1, len(regex.findall(r"\p{L}", text)))
    count = lambda p: len(regex.findall(p, text))
    return (
        (len(a) + sum(map(masked, w))) / n, len(d & abuse) + len(hidden), sum(x in learned for x in w) / n, len(d & set(learned)), len(stemmed) / n, len(set(stemmed)), len(y) / n,
        min([99, *(abs(i - j) for i in a for j in y)]), count(r"\p{Lu}") / letters, count(r"(?<!\p{L})\p{Lu}{4,}+(?!\p{L})") / n, count("[!?]") / n, count("[!?]{2,}") / n,
        count(r"\p{L}[0-9@$*!]+\p{L}") / n, count(r"(\p{L})\1\1") / n, math.log1p(n),
    )


def test_toxicity_features_equal_brute_force(spark, texts):
    learned, stems = ["the", "and", "ende"], ["stth", "ereou", "thstthe"]
    odd = ["", "  ", "YOU IDIOT!!! you 1d1ot", "die die die du", "st*pid \u00c9T\u00c9S a@b", "sooo baaad $$$"]
    rows = [(i, t or "") for i, t in enumerate([*texts.values(), *odd])]
    df = spark.createDataFrame(rows, "i long, text string").select("i", toxicity.features(F.col("text"), learned, stems).alias("f"))
    every = dict(rows)
    for r in df.collect():
        assert [round(x, 9) for x in r.f] == [round(float(x), 9) for x in _plain_features(every[r.i], learned, stems)], every[r.i][:80]


def test_toxicity_never_sees_held_out_labels(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["you idiot", "stupid loser", "a calm walk", "the river", "blorp" if i % 2 else "green"]) for _ in range(12)), i % 2) for i in range(600)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    got = []
    for flip in (False, True):
        at = str(tmp_path / f"t{flip}")
        spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1 - y if flip and held[i] else y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        got.append({r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op9_toxicity(spark, at).collect()})
    assert got[0] == got[1] and len(got[0]) == 600
    assert all(h == held[i] and 0 <= s <= 1 and p == (s >= 0.5) for i, (h, s, p) in got[0].items())


def test_area_under_the_curve():
    assert toxicity._area({(0, 0): 3, (1, 1): 2}) == 1.0 and toxicity._area({(0, 0): 2, (0, 1): 2}) == 0.5 and toxicity._area({(1, 1): 2}) == 0.5


def test_names_are_bound_in_open_blocks():
    rng, bits = np.random.default_rng(3), ["a = ", "b: ", '"xyz" + a', "b", "a", "\n", "\n  ", "\n    ", "{", "}", ";"]
    for _ in range(500):
        every, last = secrets.pairs("".join(rng.choice(bits, 40)))
        open_ = lambda j, i: every[j].scope <= every[i].scope <= last[every[j].scope]  # noqa: B023, E731

        def bound(name, i):
            same = [j for j, p in enumerate(every) if p.name == name and j != i and open_(j, i)]  # noqa: B023
            return max((j for j in same if j < i), default=min(same, default=None))

        assert secrets._links(every, last) == [[None if r is None else bound(r, i) for *_, r in p.parts] for i, p in enumerate(every)]


@pytest.mark.parametrize("text", ["token = 1\n" + "{id:id}," * 50_000, "token:" + '{"a":b,"x":' * 50_000, "token=1;" + "a=5;" * 50_000], ids=["side by side", "nested", "one line"])
def test_many_blocks_take_time_in_proportion(text):
    began = time.perf_counter()
    secrets.find_secrets(text)
    assert time.perf_counter() - began < 30


def test_spans_of_a_long_text(spark):
    text = "é " + "".join(f"at 10.{i % 200}.3.{i % 99} \U0001f600 and " for i in range(10_000))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "10.0.0.1")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.s] for r in rows.select("doc_id", pii.match_spans(F.col("text"), pii.PATTERNS["ip"]).alias("s")).collect()}
    assert got == {1: [(*m.span(), m[0]) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text)], 2: [], 3: [(0, 8, "10.0.0.1")]}
    sums = spark.range(1).select(pii.running(F.sequence(F.lit(1), F.lit(1000)), 7).alias("s"), pii.running(F.array().cast("array<int>")).alias("none")).first()
    assert sums.s == [i * (i + 1) // 2 for i in range(1000)] and sums.none == []


def test_the_sketch_is_held_once_by_the_driver(spark):
    width, bits = jaccard._BLOCK, 22
    most = np.full(width, (1 << 32) - 1, np.uint32).tobytes()
    some = np.arange(width, dtype=np.uint32).tobytes()
    blocks = spark.createDataFrame([("0", bytearray(most)), ("0", bytearray(some)), ("3", bytearray(some)), ("3", bytearray(some))], "id string, data binary")
    tracemalloc.start()
    got = jaccard._frequencies(blocks, bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.dtype == np.uint32 and len(got) == 1 << bits and peak < 2 * got.nbytes
    assert (got[:width] == (1 << 32) - 1).all() and (got[3 * width : 4 * width] == 2 * np.arange(width)).all() and not got[width : 3 * width].any()
