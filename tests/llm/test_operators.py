"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from plumbline.llm import crf, fingerprint, linededup, mixing, packing, rules, secrets, simhash, toxicity, urls

#: Columns besides those of documents, with names that operators use inside.
EXTRA = ("copy", "fp", "key", "_id", "_copy", "_n", "K_id", "k_copy", "k_own", "k_row", "k_rows", "k_times", "removed", "n", "root", "v")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)


def rows_of(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ce", "Dí", "fo") for b in ("ma", "ne", "pi") for c in ("", "t", "rs.")]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(30)]
    out = []
    for i in range(n):
        text = rng.choice(["\n", "\n\n"]).join(rng.choices(lines, k=rng.randint(1, 8)))
        if rng.random() < 0.3 and out and out[-1][1]:
            text = out[-1][1].replace("ma", "me", 1)
        out.append((i, text, "en", f"s{rng.randint(0, 3)}", len(text)))
    long = " ".join(rng.choices(vocabulary, k=20_000))
    out += [(n, long, "en", "s1", len(long)), (n + 1, long + " end", "en", None, 1), (n + 2, None, None, None, None)]
    out += [(n + 3, "", "en", "s0", 0), (n + 4, " \n\t ", "en", "s0", 4), (None, lines[0], "en", "s0", 1), out[0], out[0]]
    out += [(0, "another text of the same id", "en", "s2", 5), (n + 9, "one", "en", "s9", 3), (n + 10, "two words", "", "s9", 3)]
    return [(*r, *(f"{c}!" for c in EXTRA)) for r in out]


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return rows_of(request.param)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, v) for v in x)


def keeps_extra(frame):
    """Whether rows still have what they had in the columns besides those of documents."""
    return all(tuple(r[c] for c in EXTRA) == tuple(f"{c}!" for c in EXTRA) for r in frame.collect())


def written(spark, folder, **tables):
    """A folder of tables, each (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# urls -------------------------------------------------------------------------------------------------------------


def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
        "https://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "https://x.org": ("x.org", "", None, "allow"),
        "https://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.org?a/b": ("É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(cases)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_ranks_follow_links(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.net" for i in range(12)] + ["good.org", "bad.com"]
    pages = [(0, "http://good.org/a", ""), (1, "http://bad.com/de/", "")]
    links = Counter()
    for i in range(80):
        a, b = rng.sample(hosts, 2)
        links[a, b] += 1
        pages.append((i + 2, f"http://{a}/p", f'<a class=x href="https://{b}/q">t</a> <a href="/local">'))
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert out.count() == len(pages)

    def rank(edges, seeds):
        at = {h: seeds.get(h, 0) * 0.15 for h in hosts}
        total, wave = dict(at), at
        for _ in range(urls.ROUNDS):
            new = dict.fromkeys(hosts, 0.0)
            for (a, b), n in edges.items():
                new[b] += 0.85 * wave[a] * n / sum(m for (x, _), m in edges.items() if x == a)
            wave = new
            total = {h: total[h] + wave[h] for h in hosts}
        return total

    trust = rank(links, {"good.org": 1.0})
    bad = rank({(b, a): n for (a, b), n in links.items()}, {"bad.com": 1.0})
    for r in out.collect():
        assert r.trust == pytest.approx(trust[r.host]) and r.distrust == pytest.approx(bad[r.host])
        if r.rule is None:
            assert r.verdict == ("block" if bad[r.host] > trust[r.host] and bad[r.host] >= urls.FLOOR else "allow")


def test_floor_follows_seeds_and_ranks_converge(spark):
    seeds = [(i, f"http://b{i}.com/de/", "") for i in range(3000)]
    pages = [*seeds, (-1, "http://b7.com/x", ""), (-2, "http://c.net/x", "<a href='http://b7.com/'>")]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id < 0").collect()
    assert {r.page_id: r.verdict for r in out} == {-1: "block", -2: "block"}
    chain = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(15)], "src string, dst string, n long")
    ranks = {r.host: r["rank"] for r in urls.page_rank(chain, spark.createDataFrame([("h0", 1)], "host string, n long")).collect()}
    assert ranks == pytest.approx({f"h{i}": 0.15 * 0.85**i for i in range(16)})


# fingerprints -----------------------------------------------------------------------------------------------------


def test_next_and_edited(spark, docs, rows):
    got = fingerprint.with_next(docs, 5).collect()
    order = sorted([(r[0], r[1] or "") for r in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fingerprint.with_next(docs.limit(0), 5).count() == 0


def test_fingerprints(docs, rows):
    found = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprint_documents(docs).collect()}
    assert found == {(r[0], fingerprint.fingerprint(r[1])) for r in rows}
    texts = sorted({r[1] or "" for r in rows})
    assert len({fingerprint.fingerprint(t) for t in texts}) == len(texts)
    assert all(fingerprint.Tree(fingerprint.fingerprint(t)).holds() for t in texts)
    assert fingerprint.edited("abcde", "xyz") == "abcxy" and fingerprint.edited("abcde", "") == "abc"


def test_trees_locate_edits():
    """A paragraph put in, taken out or changed is the only one that differs, wherever it is."""
    rng = random.Random(7)
    paragraph = lambda: " ".join(f"w{rng.getrandbits(20)}" for _ in range(rng.randint(1, 40)))
    for _ in range(200):
        text = [paragraph() for _ in range(rng.randint(1, 12))]
        at, mark = rng.randrange(len(text)), fingerprint.fingerprint("\n".join(text))
        other = fingerprint.fingerprint("\n".join([*text[:at], paragraph(), *text[at:]]))
        assert fingerprint.differing(mark, other) == ([], [(0, at)]) and fingerprint.differing(other, mark) == ([(0, at)], [])
        other = fingerprint.fingerprint("\n".join([*text[:at], paragraph(), *text[at + 1 :]]))
        assert fingerprint.differing(mark, other) == ([(0, at)], [(0, at)])
        assert fingerprint.compared(mark, other)[1:] == (1, f"0.{at}") and fingerprint.differing(mark, mark) == ([], [])
    sections = ["\n".join(paragraph() for _ in range(3)) for _ in range(4)]
    one, two = "\n\n".join(sections), "\n\n".join([sections[0], "new\nnew two", *sections[1:3], sections[3].replace("w", "v", 1)])
    gone, come = fingerprint.differing(fingerprint.fingerprint(one), fingerprint.fingerprint(two))
    assert gone == [(3, 0)] and come[-1] == (4, 0) and {i for i, _ in come[:-1]} == {1}


def test_aligned_is_a_longest_chain():
    rng = random.Random(8)
    for _ in range(300):
        a = rng.sample(range(12), rng.randint(0, 9))
        b = rng.sample(range(12), rng.randint(0, 9))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = fingerprint.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == best[-1][-1]
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_likeness_is_even_over_lengths():
    """A few characters at the end of a text cost no more than their share of pieces, at every length."""
    rng = random.Random(9)
    for n in range(45, 400, 3):
        text = "".join(rng.choices("abcdefghij klm", k=n))
        assert fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(text + " later")) > 1 - 80 / n
        assert fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint("".join(rng.choices("nopqrstuvw xyz", k=n)))) == 0


def test_fingerprint_query(spark, rows, tmp_path):
    some = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] != "another text of the same id"})
    folder = written(spark, tmp_path, documents=(some, "doc_id long, text string"))
    texts = [t or "" for _, t in some]
    want = {}
    for (i, _), t, after in zip(some, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        mark, other, nxt = map(fingerprint.fingerprint, (t, changed, after))
        want[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), mark, other, fingerprint.likeness(mark, other), fingerprint.likeness(mark, nxt))
    got = fingerprint.op2_fingerprint(spark, folder).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in got} == want and len(got) == len(some)
    for r in got:
        assert (r.edited_branches == 0) == (r.first_edit is None) and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)


# classifiers ------------------------------------------------------------------------------------------------------


def labelled(n=300):
    import pandas as pd

    rng = random.Random(9)
    good = lambda: "\n".join(" ".join(rng.choices(["the", "river", "runs", "to", "seas."], k=9)) for _ in range(4))
    bad = lambda: "\n".join(" ".join(rng.choices(["BUYING!!", "LOUDER###", "winner$$$"], k=9)) for _ in range(4))
    return pd.DataFrame([(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(n)], columns=["doc_id", "text", "label"])


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    emit, link, sizes = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([3, 4])
    got, pairs, logs = crf.marginals(emit, sizes, link)
    want, want_pairs, at = np.zeros((7, 2)), np.zeros((2, 2)), 0
    for k, n in enumerate(sizes):
        scores = {}
        for c in np.ndindex(*[2] * n):
            scores[c] = np.exp(sum(emit[at + i, s] for i, s in enumerate(c)) + sum(link[a, b] for a, b in zip(c, c[1:])))
        total = sum(scores.values())
        assert logs[k] == pytest.approx(np.log(total))
        for c, v in scores.items():
            for i, s in enumerate(c):
                want[at + i, s] += v / total
            for a, b in zip(c, c[1:]):
                want_pairs[a, b] += v / total
        at += n
    assert got == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    x, sizes, labels = rng.normal(size=(9, 3 * crf.OWN)), np.array([4, 1, 3, 1]), np.array([1, 0, 0, 1])
    field = crf.Field(rng.normal(size=3 * crf.OWN) / 5, rng.normal(size=(2, 2)))
    by_weight, by_link, _ = crf.gradient(field, x, sizes, labels)
    for k in (0, 7, 40):
        step = np.zeros(3 * crf.OWN)
        step[k] = 1e-5
        up, down = (crf.gradient(crf.Field(field.weights + d, field.link), x, sizes, labels)[2] for d in (step, -step))
        assert by_weight[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    for i, j in np.ndindex(2, 2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        up, down = (crf.gradient(crf.Field(field.weights, field.link + d), x, sizes, labels)[2] for d in (step, -step))
        assert by_link[i, j] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_small_samples_have_a_prior():
    none = labelled(0)
    assert crf.fit(none).score(["a b", "", None]) == pytest.approx([0.5] * 3)
    assert [r[-1] for r in rules.Scorer(rules.fit(none)).rows(["a b", None])] == pytest.approx([0.5, 0.5])
    model = toxicity.fit(none)
    assert model["lexicon"] == {} and 0 <= model["bias"] + 20 < 20


def test_label_queries(spark, tmp_path):
    """The classifiers' queries on labelled rows: folds, thresholds, base rules and held-out accuracy."""
    sample = labelled(500)
    some = [(int(i), t, int(y)) for i, t, y in sample.itertuples(index=False)]
    docs = [(i, t) for i, t, _ in some] + [(9000, None), (9001, ""), (9002, "a " * 100)]
    folder = written(spark, tmp_path, documents=(docs, "doc_id long, text string"), labels=([(i, y, 1 - y) for i, _, y in some], "doc_id long, quality int, toxic int"))
    label = {i: y for i, _, y in some}
    got = crf.op3_quality_classifier(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        assert r.doc_id not in label or r.predicted == label[r.doc_id]
    for r in rules.op6_quality_rules(spark, folder).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= rules.KEEP)
        assert r.doc_id not in label or r.base_failed or r.kept == bool(label[r.doc_id])


def test_field_learns(docs, none, rows):
    sample = labelled()
    field = crf.fit(sample)
    assert field.link[0, 0] > field.link[0, 1] and field.link[1, 1] > field.link[1, 0]
    scores = field.score(sample["text"].tolist())
    assert ((scores >= 0.3) == (sample["label"] == 1)).all()
    got = crf.score_documents(docs, field).collect()
    want = Counter((r[0], round(float(field.score([r[1]])[0]), 9)) for r in rows)
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert crf.score_documents(none, field).count() == 0
    assert crf.keep_good(docs, field).columns == docs.columns
    assert crf.keep_good(docs, field).count() == sum(n for (_, s), n in want.items() if s >= 0.3)


def test_rules_counts(docs, none, rows):
    model = rules.fit(labelled())
    got = {(r.doc_id, *(getattr(r, c) for c in rules.COUNTS)) for r in rules.score_quality(docs, model).collect()}

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            dup += line in lines and bool(line.strip(" \t\n\r\v\f"))
            lines.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)

    assert got == {(r[0], *brute(r[1])) for r in rows}
    assert rules.score_quality(none, model).count() == 0
    rng = random.Random(2)
    for _ in range(500):
        t = " ".join(rng.choices("ab", k=rng.randint(0, 30)))
        assert rules.Scorer(model).rows([t])[0][:5] == brute(t)
    scores = [r[-1] for r in rules.Scorer(model).rows(labelled()["text"].tolist())]
    assert [s >= 0.3 for s in scores] == [bool(x) for x in labelled()["label"]]


LEXICON = {"idiot": 1.0, "moron*": 1.0, "trash": 0.5, "stup*": 1.0, "grün": 0.7}


def test_toxicity_matches():
    machine = toxicity.automaton(LEXICON)
    count = lambda t: toxicity.matched(t, machine)[1]
    assert count("You IDIOT!") == count("you 1d10t") == count("ѕtupid.") == count("a m\u00f3ron,") == count("trash") == count("grün") == 1
    assert count("i d i o t") == count("idiooooot") == count("an i.d.i.o.t, no") == count("id-iot") == count("i*d*i*o*t") == count("Grün!") == 1
    assert count("the trash can is full") == count("idiotic") == count("") == count(None) == count("grun") == 0
    assert count("morons moronic stupor") == 3 and count("trash can trash") == 1
    assert toxicity.automaton({}) and toxicity.matched("idiot", toxicity.automaton({}, ())) == (0.0, 0, 1)


def test_toxicity_spelled_words_count_once():
    machine = toxicity.automaton(LEXICON)
    for text, want in (("i.d.i.o.t", (1.0, 1, 1)), ("t-r-a-s-h i d i o t", (1.5, 2, 2)), ("a a a a idiot", (1.0, 1, 5)), ("id-iot", (1.0, 1, 3))):
        assert toxicity.matched(text, machine) == want


def test_toxicity_by_brute_force():
    rng, machine = random.Random(5), toxicity.automaton(LEXICON, ("trash can", "can of stupid worms"))
    vocabulary = ["idiot", "trash", "can", "of", "stupid", "worms", "morons", "a", "the", "Idiots", "st", "up"]
    safe = [("trash", "can"), ("can", "of", "stupid", "worms")]
    for _ in range(3000):
        parts = rng.choices(vocabulary, k=rng.randint(0, 30))
        words = [w.lower() for w in parts]
        covered = {i + k for phrase in safe for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase for k in range(len(phrase))}
        hits = [LEXICON[e] for i, w in enumerate(words) if i not in covered for e in LEXICON if w == e or (e[-1] == "*" and w.startswith(e[:-1]))]
        got = toxicity.matched(" ".join(parts), machine)
        assert got[1:] == (len(hits), len(words)) and got[0] == pytest.approx(sum(hits))
    many = " ".join(["trash can"] * 100_000)
    start = time.process_time()
    assert toxicity.matched(many, machine)[1] == 0 and time.process_time() - start < 20


def test_toxicity_learns_words_it_has_not(spark, docs, none, rows, tmp_path):
    """Held-out accuracy on words and stems made up here, in short and long texts, with copies of a toxic text."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abdeghilmnoprstuv", k=rng.randint(2, 7))) for _ in range(3000)]
    marks, stems = ["zorvex", "quibnak", "främpf", "wuzzog"], ["jokkel", "pyxa"]

    def text(toxic):
        words = rng.choices(vocabulary, k=rng.choice([20, 60, 200, 1500]))
        for _ in range(rng.randint(1, 4) if toxic else 0):
            mark = rng.choice(marks) if rng.random() < 0.6 else rng.choice(stems) + rng.choice(vocabulary)
            words.insert(rng.randrange(len(words)), rng.choice([mark, mark.upper(), mark.replace("o", "0"), mark + "!"]))
        return " ".join(words)

    some = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(4000)]
    copied = some[8][1]
    some += [(5000 + i, copied, 1) for i in range(100)]
    folder = written(spark, tmp_path, documents=([x[:2] for x in some], "doc_id long, text string"), labels=([(i, 1, y) for i, _, y in some], "doc_id long, quality int, toxic int"))
    held = defaultdict(list)
    for r in toxicity.op10_toxicity(spark, folder).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id < 5000:
            held[r.doc_id % 8 == 0].append(r.predicted)
    assert np.mean(held[True]) >= 0.9 and np.mean(held[False]) <= 0.02
    model = {"lexicon": LEXICON, "power": 0.5, "slope": 4.0, "bias": -3.0}
    assert Counter(r.doc_id for r in toxicity.score_toxicity(docs, model).collect()) == Counter(r[0] for r in rows)
    assert toxicity.score_toxicity(none, model).count() == 0


# packing ----------------------------------------------------------------------------------------------------------


def test_pieces_and_packing(docs, none, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(packing.pieces(docs)).collect()
    want, tokens = Counter(), 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        tokens += len(ids)
        first = len(ids) % packing.SIZE or packing.SIZE
        starts = [0, *range(first, len(ids), packing.SIZE)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in out) == want
    assert all(p.length == packing.SIZE or p.piece == 0 for p in out)
    places = defaultdict(list)
    for p in out:
        places[p.sequence_id].append((p.offset, p.length))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert len(places) <= 1.1 * tokens / packing.SIZE + 1
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packing_in_parts(docs, monkeypatch):
    """Lengths whose pieces are numbered in parts get the same sequences."""
    pieces = packing.pieces(docs)
    whole = packing.pack(pieces).groupBy("sequence_id").sum("length").collect()
    monkeypatch.setattr(packing, "PART", 7)
    parts = packing.pack(pieces).collect()
    assert Counter(r[1] for r in whole) == Counter(sum(p.length for p in parts if p.sequence_id == i) for i in {p.sequence_id for p in parts})
    assert len({(p.sequence_id, p.offset) for p in parts}) == len(parts) == pieces.count()


def test_tokens_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    tokenizer, encoder, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()), random.Random(3)
    odd = ["a <|endoftext|> b", "x\x85y\u2003 z", "\u00b2\u00b3 \u00bd caf\u00e9", "", "don't  stop\n\n\n x_y __ 12a\x1c b", "\U0001f600 hi"]
    for text in odd + ["".join(rng.choices("ab1_ '\n\té\u00f1.,-\u00b2 \u00a0stre", k=40)) for _ in range(1500)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_places_every_rank_once():
    rng = random.Random(5)
    for _ in range(200):
        histogram = {rng.randint(1, 20): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        seen = defaultdict(list)
        for _, n, places in packing.plan(histogram, 20):
            assert sum(k for k, _ in places) <= 20
            for k, first in places:
                seen[k] += range(first, first + n)
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}


# mixing -----------------------------------------------------------------------------------------------------------


def fill(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, total = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    left = total
    while free and left > 1e-9:
        all_ = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / all_ > 3 * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / all_
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


MODEL = [1.0, -3.0, -2.0, 0.0, -0.5, 0.2]


def test_quality_weights(spark, docs):
    sample = labelled()
    some = spark.createDataFrame([(int(i), t) for i, t, _ in sample.itertuples(index=False)], "doc_id long, text string")
    labels = spark.createDataFrame([(int(i), int(y)) for i, _, y in sample.itertuples(index=False)], "doc_id long, quality int")
    model = mixing.fit(some, labels)
    weight = mixing.quality_weight(mixing.F.col("text"), mixing.word_count(mixing.F.col("text")), model)
    got = {r.doc_id: r.w for r in some.select("doc_id", weight.alias("w")).collect()}
    good, bad = [[got[i] for i, _, y in sample.itertuples(index=False) if y == k] for k in (1, 0)]
    assert min(good) > 0.8 and max(bad) < 0.3
    assert mixing.fit(some.limit(0), labels) == [0.0] * 6
    assert all(mixing.LEAST <= r.w <= 1 for r in docs.select(weight.alias("w")).collect())


def test_better_documents_are_taken_more(spark):
    """Of a source that is taken in part, documents with more weight have the least keys more often."""
    rows = [(i, "a b c d !!!! ####" if i % 2 else "a b c d e f", "s0" if i < 2000 else "t") for i in range(2100)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), [3.0, -5.0, -5.0, 0.0, 0.0, 0.0]).where("source = 's0'").collect()
    taken = Counter((r.doc_id % 2, r.epochs) for r in out)
    assert {r.epochs for r in out} == {0, 1} and taken[0, 1] > taken[1, 1] + 100


def test_mix(docs, none, rows):
    out = mixing.mixed(docs, MODEL).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    target, taken = fill(dict(sizes)), Counter()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], words(r[1])) for r in rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(5), MODEL).collect()))
    kept = mixing.repeated_to_targets(docs, MODEL)
    assert kept.columns == docs.columns and keeps_extra(kept)
    assert sum(words(r.text) for r in kept.collect()) == sum(taken.values())
    assert mixing.mixed(none, MODEL).count() == mixing.repeated_to_targets(none, MODEL).count() == 0


def test_targets_by_water_filling(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 1000, 10**6]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 50)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(fill(sizes))


def test_words_go_to_the_model_alone(monkeypatch):
    """Texts of plain characters get the tokenizer's ids without a run of the whole tokenizer for each word."""
    encoder, rng = packing.Encoder(packing.tokenizer_path()), random.Random(12)
    whole = lambda t: encoder._tokenizer.encode(t, add_special_tokens=False).ids
    plain = [chr(c) for c in range(0x180) if not packing.OTHER.search(chr(c))]
    parts = [*plain, *"     \n\n\t", *("'" * 4), "'s", "'re", "'ll", "n't", "the", " river", "__", "12", "ción", "Straße"]
    texts = [a + b for a in plain for b in ("", "a", " ", "'", "7")] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    want = [whole(t) for t in texts]
    monkeypatch.setattr(encoder, "_whole", None)
    special = [t for t in texts if any(s in t for s in encoder._special)]
    assert not special
    for t, ids in zip(texts, want, strict=True):
        assert list(memoryview(encoder.encode(t)).cast("I")) == ids, t


# near duplicates --------------------------------------------------------------------------------------------------


def test_simhash_value():
    for text in ["A b\tC d e", "x", "x y", "", None, "é É ß a\u00a0b c d"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_links_by_brute_force(spark, seed):
    rng = random.Random(seed)
    codes = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):  # chains and stars at distances around the limit
            codes.add(x)
            y = x
            for _ in range(rng.randint(1, 5)):
                y ^= 1 << rng.randrange(64)
            codes.add(y)
            x = rng.choice([x, y])
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    got = simhash.link_fingerprints(spark.createDataFrame([(signed(c),) for c in codes], "fp long")).collect()
    groups, want = defaultdict(set), defaultdict(set)
    for r in got:
        groups[r.root].add(r.fp)
    for c, r in brute_components(codes).items():
        want[r].add(signed(c))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(got) == len(codes)


def test_near_duplicates(docs, none, rows):
    out = simhash.near_duplicates(docs).collect()
    root = brute_components({simhash.simhash(r[1]) for r in rows})
    ids = defaultdict(list)
    for r in rows:
        ids[root[simhash.simhash(r[1])]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((r[0], least[root[simhash.simhash(r[1])]]) for r in rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids) and keeps_extra(kept)
    assert simhash.near_duplicates(none).count() == simhash.keep_one_of_each(none).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_components_by_union_find(spark, parts, monkeypatch):
    """Chains, stars and cycles in one partition and in many: the least vertex by any path, in few jobs."""
    rng = random.Random(parts)
    edges = [(i, i + 1) for i in range(60)] + [(-100 - i, -100) for i in range(40)] + [(1000, 1001), (1001, 1000), (7, 7)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(130)] + [(9, 9), (1 << 62, -(1 << 62))]
    rng.shuffle(edges)
    root = {v: v for e in edges if e[0] != e[1] for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    made, kept = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: made.append(1) or kept(df))
    monkeypatch.setattr(simhash, "settled", lambda df: kept(df.repartition(parts)))
    frame = spark.createDataFrame(edges, "a long, b long")
    got = simhash.components(frame).collect()
    assert sorted(map(tuple, got)) == sorted((v, find(v)) for v in root)
    assert len(made) <= (1 if parts == 1 else 8)
    more = simhash._joined(simhash.components(frame), spark.createDataFrame([(1000, 3), (5000, 6000)], "a long, b long"))
    assert {r.v: r.root for r in more.collect()} == {v: find(v) if find(v) != 1000 else 0 for v in root} | {5000: 5000, 6000: 5000}
    assert simhash.components(frame.limit(0)).count() == 0


def brute_jaccard(texts):
    """The least text of each text's component of links of 0.8 or more between sets of five-word shingles."""
    texts, sets = sorted(texts), {}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[t] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {t: find(t) for t in texts}


def edited_copies(seed):
    """Chains and stars of copies with edited words, at similarities around the limit, and a passage that many share."""
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    for _ in range(20):
        one = rng.choices(vocabulary, k=rng.randint(1, 150)) + passage * rng.randint(0, 1)
        for _ in range(rng.randint(1, 8)):
            out.append(" ".join(one))
            two = list(one)
            for _ in range(rng.randint(0, 1 + len(two) // 40)):
                two[rng.randrange(len(two))] = rng.choice(vocabulary)
            one = rng.choice([one, two])
            out.append(" ".join(two))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_shingle_links_by_brute_force(spark, docs, none, rows, seed, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", (10, 2)[seed])
    more = [(1000 + i, t) for i, t in enumerate(edited_copies(seed))] + [(r[0], r[1]) for r in rows]
    frame = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    root = brute_jaccard({t or "" for _, t in more})
    ids = defaultdict(list)
    for i, t in more:
        ids[root[t or ""]].append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    out = simhash.near_duplicates(frame, 5, 0.8).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((i, least[root[t or ""]]) for i, t in more)
    kept = simhash.keep_one_of_each(docs, 5, 0.8)
    assert kept.columns == docs.columns and kept.count() == len({brute_root for t, brute_root in brute_jaccard({r[1] or "" for r in rows}).items()})
    assert simhash.near_duplicates(none, 5, 0.8).count() == 0


def test_stage_takes_copies_with_edited_words(spark):
    words = [f"w{i}" for i in range(200)]
    other = ["x" if i % 60 == 30 else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    assert (simhash.simhash(a) ^ simhash.simhash(b)).bit_count() > simhash.BITS
    docs = spark.createDataFrame([(2, b), (1, a), (3, "w1 w2")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


# secrets ----------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(secrets.BASE[0].head.replace("([Pp]", "(?:[Pp]", 1).replace("[A-Za-z0-9+/_.=-]", "([A-Za-z0-9+/_.=-]+)"))


def brute_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets_by_regular_expressions(docs, none, rows):
    scanner, rng = secrets.Scanner(), random.Random(1)
    parts = ["token", "secret", "PassWord", "passwd", "api_key", "apikey", ":", "=", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8"]
    parts += ["0123456789abcdef", "ab", "é", "x.y", "-----BEGIN RSA PRIVATE KEY-----", "\n", "eyJ", "."]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert [s for s in scanner.spans(text) if s[1] < 3] == brute_spans(text)
    pem, token = "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "Z9" * 18
    assert [scanner.rules[i].kind for _, i, _ in scanner.spans(f"é {pem} {token}")] == ["pem", "github"]
    assert secrets.scan_secrets(docs).count() == len(rows) and secrets.scan_secrets(none).count() == 0


def test_secret_query(spark, rows, tmp_path):
    """The query's counts, digests and spans, from the regular expressions."""
    parts = ["token", "passwd", "api_key", ":", "=", " ", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "x.y", "\n"]
    rng = random.Random(4)
    some = [*((r[0], r[1]) for r in rows), *((1000 + i, "".join(rng.choices(parts, k=12))) for i in range(300))]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kinds, want = ("assign", "access", "hex"), Counter()
    for i, t in some:
        found = brute_spans(t or "")
        shown = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
        n = Counter(k for _, k, _ in found)
        want[i, n[0], n[1], n[2], hashlib.sha256(shown.encode()).hexdigest(), shown] += 1
    got = secrets.op8_secret_scan(spark, str(tmp_path)).collect()
    base = lambda x: ",".join(s for s in x.split(",") if s.split(":")[0] in kinds)
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, base(r.spans)) for r in got) == want


def test_secrets_in_linear_time():
    """A million characters of the head of any rule, over and over, are read in seconds, not hours."""
    scanner = secrets.Scanner()
    heads = ["eyJa", "-----BEGIN ", "-----BEGIN A ", "ghp_a", "xoxb-a", "AIzaa", "sk_live_a", "AKIA", "password=", "token : ", "api_key  ", "eyJa.eyJa."]
    for head in heads:
        start = time.process_time()
        scanner.spans(head * (1_000_000 // len(head)))
        assert time.process_time() - start < 30, head


# lines ------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, none, rows):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == len(rows) and keeps_extra(out)
    got = out.collect()
    before = defaultdict(set)
    for r in rows:
        before[r[0]].add(r[1])
    # what is left is a subsequence of lines, and nulls and texts without repeats stay
    for r in got:
        assert any(subsequence((r.text or "").split("\n"), (t or "").split("\n")) for t in before[r.doc_id])
    # every line with words is still somewhere
    had = {x for r in rows for x in (r[1] or "").split("\n") if x.strip()}
    assert {x for r in got for x in (r.text or "").split("\n") if x.strip()} == had
    assert linededup.dedup_lines(none).count() == 0


def subsequence(a, b):
    it = iter(b)
    return a == [""] or all(x in it for x in a)


def test_line_dedup_cases(spark):
    w = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    passage = "\n".join([w("p", 20), w("q", 20), w("r", 15)])
    long, short = w("long", 60), w("short", 10)
    cases = [
        (1, f"{w('a', 9)}\n{passage}\n{short}\n{w('b', 9)}"),
        (2, f"{w('c', 9)}\n{passage}\n{w('d', 9)}"),
        (3, f"{w('e', 9)}\n{long}\n{short}"),
        (4, f"{w('f', 9)}\n\n{long}\n{w('g', 9)}"),
        (5, f"{long}\n{w('h', 9)}\n{long}"),
        (6, short),
        (7, None),
        (8, passage),
    ]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got[1] == cases[0][1] and got[3] == cases[2][1] and got[6] == short and got[7] is None
    assert got[2] == f"{w('c', 9)}\n{w('d', 9)}"
    assert got[4] == f"{w('f', 9)}\n\n{w('g', 9)}"
    assert got[5] == w("h", 9)
    assert got[8] == ""


def test_line_dedup_takes_whole_runs(spark):
    """All lines of repeated runs of 50 words or more go, and only lines of runs of 25 or more, as by brute force."""
    rng = random.Random(3)
    new = lambda n: " ".join(f"n{rng.getrandbits(40)}" for _ in range(n))
    hot, pool, rows = new(30), [new(rng.randint(1, 30)) for _ in range(12)], [(0, "")]
    rows[0] = (0, f"{new(9)}\n{hot}\n{new(9)}")
    for i in range(40):
        passage = "\n".join([new(20), hot, new(20), new(4)])
        rows += [(3 * i + k, f"{new(9)}\n{passage}\n{new(9)}") for k in (1, 2)]
        rows.append((3 * i + 3, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))))
    rows.append((999, "\n".join(["a b"] * 300)))
    texts = {i: t.split("\n") for i, t in rows}
    size = {x: len(x.split()) for t in texts.values() for x in t}
    seen, least, most = set(), {}, {}
    for i, t in sorted(texts.items()):
        least[i], most[i] = set(), set()
        for lo in range(len(t)):
            words = 0
            for hi in range(lo, len(t)):
                words += size[t[hi]]
                run = tuple(t[lo : hi + 1])
                if words >= 25 and run in seen:
                    most[i] |= set(range(lo, hi + 1))
                    if words >= 50:
                        least[i] |= set(range(lo, hi + 1))
                seen.add(run)
                if words >= 110:
                    break
    left = lambda t, gone: Counter(x for k, x in enumerate(t) if k not in gone)
    for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got = Counter((r.text or "").split("\n") if r.text else [])
        assert left(texts[r.doc_id], most[r.doc_id]) <= got <= left(texts[r.doc_id], least[r.doc_id]), r.doc_id
    blank = [(1, f"{hot}\n\n{new(60)}"), (2, "")]
    blank[1] = (2, blank[0][1] + "\n\nend")
    got = linededup.dedup_lines(spark.createDataFrame(blank, "doc_id long, text string")).where("doc_id = 2").first()
    assert got.text == "\nend"
