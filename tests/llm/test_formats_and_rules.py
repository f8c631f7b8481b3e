import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_shared import brute_rules

from meshwork.llm import chat_format, importance, license_scan, quality_rules, source_mixing, url_filter
from meshwork.session import materialize


# ---- quality rules


def test_quality_rules_against_brute_force(frame, sample, odd):
    repeated = [(3000, "a b c " * 40, "z"), (3001, " ".join(f"q{i % 30}" for i in range(200)), "z"), (3002, "a a a a", "z"), (3003, "x\nx\n \nx y\nx y", "z"), (3004, " ".join(f"u{i} v{i} w{i}" for i in range(60)) * 2, "z")]
    rows = sample + odd + repeated
    got = quality_rules.quality_rules(frame(rows))
    have = Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert have == Counter((d, *brute_rules(t)) for d, t, _ in rows)
    bad, n = Counter(), Counter()
    for _, t, s in rows:
        n[s or ""] += 1
        bad[s or ""] += brute_rules(t)[-1]
    m = sum(bad.values()) / sum(n.values())
    v = np.var([bad[s] / n[s] for s in n])
    s0 = min(max(m * (1 - m) / v - 1, 2.0), 1000.0)
    rate = {s: (bad[s] + m * s0) / (n[s] + s0) for s in n}
    for r in got.collect():
        assert abs(r.host_rate - rate[r.domain]) < 1e-5
        assert r.kept == (not r.base_failed and rate[r.domain] <= 0.5)
    assert rate["z"] > 0.5


def test_quality_filter_keeps_columns_and_rows(frame, sample, odd):
    rows = sample + odd
    docs = frame(rows).withColumn("words", F.lit("mine")).withColumn("_host", F.lit(1))
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    want = Counter((r.doc_id) for r in quality_rules.quality_rules(frame(rows)).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert quality_rules.keep_documents(frame([])).count() == quality_rules.quality_rules(frame([])).count() == 0


# ---- importance resampling


def test_importance_against_plain_counts(frame, sample, odd, spark):
    rows = sample + odd
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = labels.where("quality = 1 and toxic = 0")
    got = importance.resample(frame(rows), good, 0.6)
    ids = {r.doc_id for r in good.collect()}
    raw, target, grams = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS), []
    for d, t, _ in rows:
        g = importance.grams_of(np.frombuffer((t or "").encode(), np.uint8))
        grams.append(g)
        np.add.at(raw, g, 1)
        if d in ids:
            np.add.at(target, g, 1)
    ratio = importance.log_ratio(raw, target)
    want = [(d, round(ratio[g].sum() * importance.UNIT / max(len(g), importance.UNIT), 6)) for (d, _, _), g in zip(rows, grams)]
    have = got.collect()
    assert Counter((r.doc_id, round(r.log_weight, 6)) for r in have) == Counter(want)
    keys = sorted((r.key for r in have), reverse=True)
    limit = keys[round(0.6 * len(rows)) - 1]
    assert all(r.kept == (r.key >= limit) for r in have)
    assert all(abs(r.key - r.log_weight - importance.noise(r.doc_id)) < 1e-9 for r in have)


def plain_grams(text):
    """Buckets of the byte n-grams, one by one."""
    data, out = (text or "").encode(), []
    for n in (2, 4):
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i : i + n]:
                h = h * 0x01000193 % 2**32 ^ b
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            out.append(h >> 18)
    return out


def test_importance_in_plain_python(frame, sample, spark):
    """Nothing of the module under test but ``resample``."""
    import math

    import xxhash

    rows = [r for r in sample if len(r[1] or "") < 1500][:40] + [(700, None, "a"), (None, "no id", "a"), (701, "x", "a"), (702, "twice", "a"), (702, "twice", "a")]
    ids = {d for d, _, _ in rows[::3] if d is not None}
    raw, target = Counter(), Counter()
    for d, t, _ in rows:
        raw.update(plain_grams(t))
        if d in ids:
            target.update(plain_grams(t))
    p = lambda c, g: (c[g] + 1) / (sum(c.values()) + 2**14)
    ratio = {g: math.log(p(target, g)) - math.log(p(raw, g)) for g in raw}
    want = []
    for d, t, _ in rows:
        g = plain_grams(t)
        weight = sum(ratio[x] for x in g) * 256 / max(len(g), 256)
        u = (xxhash.xxh64_intdigest(str(d), 20) + 0.5) / 2.0**64
        want.append((str(d), round(weight, 6), round(weight - math.log(-math.log(u)), 6)))
    limit = sorted((k for _, _, k in want), reverse=True)[round(0.5 * len(rows)) - 1]
    good = spark.createDataFrame([(d,) for d in ids], "doc_id long")
    got = importance.resample(frame(rows), good, 0.5).collect()
    assert sorted((str(r.doc_id), round(r.log_weight, 6), round(r.key, 6), r.kept) for r in got) == sorted((*w, w[2] >= limit) for w in want)


def test_importance_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0 and quality = 1 and toxic = 0"), labels.where("doc_id % 2 = 1")
    scored = importance.resample(docs, fit, 0.85).join(held, "doc_id").collect()
    good, bad = [r.log_weight for r in scored if r.quality == 1], [r.log_weight for r in scored if r.quality == 0]
    auc = np.mean([[a > b for b in bad] for a in good])
    assert auc > 0.9


def test_blocks_lose_no_gram(monkeypatch):
    text = "été " * 50 + "end"
    whole = Counter(importance.grams_of(np.frombuffer(text.encode(), np.uint8)).tolist())
    monkeypatch.setattr(importance, "BLOCK", 16)
    assert sum((Counter(g.tolist()) for g in importance._blocks(text)), Counter()) == whole


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 9000 + [3.0] * 5, list(np.linspace(0, 1, 9001))])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 3, len(values) // 2, len(values)):
        want = sorted(values, reverse=True)[k - 1] if 0 < k <= len(values) else None
        assert importance.kth_largest(df, k) == want


def test_importance_of_nothing(frame, spark):
    none = spark.createDataFrame([], "doc_id long")
    assert importance.resample(frame([]), none, 0.5).count() == 0
    assert all(r.log_weight == 0 for r in importance.resample(frame([(1, "a b c", "x"), (2, None, None)]), none, 0.5).collect())


# ---- license scans


def test_license_scan(frame):
    t = license_scan.TEMPLATES
    rows = [
        (1, "text\nLicensed under CC BY-NC 4.0.\nmore of it", "a"), (2, t["MIT-text"].upper(), "a"), (3, None, None), (4, "", "a"),
        (5, "This work is licensed under the GNU General Public License, version 3!\nReleased under the MIT license", "a"),
        (6, t["MIT-text"][:200], "a"), (7, "word " * 50_000, "a"), (7, "Released under the MIT License.", "a"),
    ]
    got = {(r.doc_id, r.licenses, r.n_matches) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {(1, "CC-BY-NC-4.0", 1), (2, "MIT-text", 1), (3, "", 0), (4, "", 0), (5, "GPL-3.0,MIT", 3), (6, "", 0), (7, "", 0), (7, "MIT", 1)}
    assert license_scan.scan(frame([])).count() == 0


@pytest.mark.parametrize("name", ["MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Apache-2.0-header", "GPL-2.0-header", "GPL-3.0-header"])
@pytest.mark.parametrize("width", [72, 40])
def test_wrapped_licenses_inside_documents(frame, name, width):
    body = "\n".join(textwrap.wrap(license_scan.TEMPLATES[name], width))
    around = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(40))
    rows = [(1, f"{around}\nCopyright (c) 2024 someone\n{body}\n\n{around}", "a"), (2, body, "a"), (3, f"/* {body.replace(chr(10), chr(10) + ' * ')}", "a"), (4, around + "\nsoftware warranty", "a"), (5, around, "a")]
    got = {r.doc_id: r for r in license_scan.scan(frame(rows).withColumns({"_hits": F.lit(1), "_all": F.lit(2), "_lines": F.lit("x")})).collect()}
    for k in (1, 2, 3):
        assert name in got[k].licenses.split(",") and got[k].license == name and got[k].dice > 0.9, k
    assert got[4].n_matches == got[5].n_matches == 0


def test_license_blocks_against_brute_force(frame):
    """Every block of every template, without the words that a text must have."""
    rng = np.random.default_rng(4)
    t, rows = license_scan.TEMPLATES, []
    for i, name in enumerate([n for n in t if len(license_scan._words_of(t[n])) >= license_scan.LONG] * 6):
        words = [w if rng.random() > 0.06 * (i // 8) else "other" for w in t[name].split()]
        lines = textwrap.wrap(" ".join(words), 60)
        rows.append((i, "\n".join(["some text"] * int(rng.integers(0, 3)) + lines[int(rng.integers(0, 2)) :] + ["more"] * int(rng.integers(0, 3))), "a"))
    rows.append((900, "Released under the MIT License. " * 100, "a"))  # five bigrams, many words
    rows.append((901, "\n".join(["Released under the MIT License."] * 200), "a"))
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan.scan(frame(rows)).collect()}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
    known = {n: set(license_scan.bigrams_of(b)) for n, b in t.items()}
    for d, text, _ in rows:
        lines, hits = text.split("\n"), []
        for unit in lines + [text] * (len(lines) > 1):
            best = max((dice(set(license_scan.bigrams_of(unit)), g), [-ord(c) for c in n], n) for n, g in known.items())
            hits += [best[2]] * (best[0] >= 0.8)
        own, starts = [], []
        for x in lines:
            w = license_scan._words_of(x)
            starts += [len(own)] * bool(w)
            own += w
        for n, g in known.items():
            size = len(license_scan._words_of(t[n]))
            if size >= license_scan.LONG and len(lines) > 1 and any(dice(set(license_scan.bigrams_of(" ".join(own[i : i + size]))), g) >= 0.8 for i in starts if len(own) - i >= size * 0.8 / 1.2):
                hits.append(n)
        assert got[d] == (len(hits), ",".join(sorted(set(hits)))), d


# ---- url filter


def brute_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1?x", "HTTPS://Example.ORG/en/12#y", "x://example.org/en/2", "http://b.com/fr/", "http://b.com/fr", "http://b.com/de/3", "ftp://notorg/es/", "nothing", None, "", "http://", "http://É.org/Ä", "a://b://c.org/d", "http://org/", "http://org?q/", "http://x.org\n/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good int")
    for r in url_filter.judge(pages, labels).collect():
        u = urls[r.page_id]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        want = brute_rule(host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((want[1], want[0]) if want else (None, "allow"))


def brute_templates(rows):
    """(host, path) -> (template, purity), from rows (host, path, good or None), by recursion over a node's paths."""
    def form(x):
        x = "{*}" if x == "*" else re.sub("([{}])", r"\1\1", x)
        x = re.sub("(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f]{8}[0-9a-f-]{4,}(?![0-9a-z])", "{x}", x)
        return re.sub("[0-9]+", "{n}", x)

    def grow(prefix, members, out):
        """members: (rest, key, good); the whole template of each key goes to ``out``."""
        kids = defaultdict(list)
        for rest, key, good in members:
            if rest:
                kids[rest[0]].append((rest[1:], key, good))
            else:
                out[key] = prefix
        total = sum(map(len, kids.values()))
        marks = lambda ms: [g for _, _, g in ms if g is not None]
        every = [g for ms in kids.values() for g in marks(ms)]
        merged = defaultdict(list)
        for name, ms in kids.items():
            own = marks(ms)
            a, b = len(own), len(every) - len(own)
            wild = len(kids) >= 16 and total < 4 * len(kids) and len(ms) < 4
            if a >= 8 and b >= 8:
                p = sum(every) / len(every)
                gap = abs(sum(own) / a - (sum(every) - sum(own)) / b)
                wild |= gap <= 1.96 * math.sqrt(p * (1 - p) * (1 / a + 1 / b))
            merged["*" if wild else name] += ms
        for name, ms in merged.items():
            grow(prefix + [name], ms, out)

    found = {}
    for host in {r[0] for r in rows}:
        out = {}
        grow([], [([form(x) for x in p.split("/") if x], (h, p), g) for h, p, g in rows if h == host], out)
        found |= out
    found = {k: "".join("/" + x for x in v) + "/" * k[1].endswith("/") for k, v in found.items()}
    known = [g for *_, g in rows if g is not None]
    share = sum(known) / len(known) if known else 0.5
    marks = defaultdict(list)
    for h, p, g in rows:
        marks[h, found[h, p]] += [g] if g is not None else []
    return {k: (v, (sum(marks[k[0], v]) + 8 * share) / (len(marks[k[0], v]) + 8)) for k, v in found.items()}


@pytest.mark.parametrize("labelled", [0.7, 0.05, 0.0])
def test_url_tree_against_brute_force(spark, labelled):
    """Random trees of up to nine levels, one node of many rare children, literal wildcards, repeated urls and ids, odd columns."""
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.org", "b.org", "b.org", ""])
        parts = [rng.choice(["x", "y", "z", "*", "{n}", "12", "v7", "deadbeef01234567"]) for _ in range(rng.choice([1, 2, 2, 3, 9]))]
        if rng.random() < 0.3:
            parts = ["q", f"name-{rng.choice('abcdefgh')}{chr(97 + i % 23)}{chr(97 + i // 23 % 5)}", "end"]
        if rng.random() < 0.2:
            parts = ["deep"] * 7 + [rng.choice("uvw")]
        pages.append((i, host, "/" + "/".join(parts) + rng.choice(["", "", "/"])))
        if rng.random() < labelled:
            labels.append((i, int(rng.random() < {"x": 0.9, "y": 0.85, "q": 0.1}.get(parts[0], 0.5))))
    marks = dict(labels)
    frame = spark.createDataFrame([(i, f"http://{h}{p}", "t", 1) for i, h, p in pages], "page_id long, url string, template string, _hit int")
    got = url_filter.judge(frame.unionByName(frame.limit(1)), spark.createDataFrame(labels + labels[:3], "page_id long, good int"), rules=[]).collect()
    assert len(got) == 1501
    got = {r.page_id: r for r in got}
    want = brute_templates([(h, p, marks.get(i)) for i, h, p in pages + pages[:1]])
    rows = {(i, h, p) for i, h, p in pages}
    assert {i: got[i].template for i, _, _ in rows} == {i: want[h, p][0] for i, h, p in rows}
    if labelled == 0:
        assert all("*" not in t.replace("{*}", "") or "/q/" in t for t, _ in want.values())
    else:
        assert all(abs(got[i].purity - want[h, p][1]) < 2e-6 for i, h, p in rows)
        assert any("*" in t.replace("{*}", "") for t, _ in want.values())


def test_url_rows_of_odd_input(spark):
    """Null ids, conflicting labels (the worst counts), very long urls."""
    long = "http://l.org/" + "s/" * 3000 + "end"
    pages = spark.createDataFrame([(None, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://a.org/x"), (2, long), (3, long)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "page_id long, good int")
    got = url_filter.judge(pages, labels, rules=[]).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == {(None, "block"): 1, (1, "block"): 2, (2, "block"): 1, (3, "block"): 1}


def test_url_templates_by_purity(spark):
    rows = [(i, f"http://a.net/good/{i}") for i in range(60)] + [(100 + i, f"http://a.net/spam/x{i}.html") for i in range(60)] + [(300 + i, f"http://b.net/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}/p") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i % 2 and i < 300], "page_id long, good int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.judge(pages, labels, rules=[]).collect()}
    assert got[0] == ("/good/{n}", "allow") and got[101] == ("/spam/x{n}.html", "block") and got[100][1] == "block"
    assert len({got[300 + i][0] for i in range(80)}) == 1 and got[300][1] == "allow"
    assert url_filter.judge(pages.limit(0), labels.limit(0)).count() == 0


# ---- chat formatting


def brute_rotation(rows):
    safe = lambda t: (t or "").replace("<|", "< |")
    talks = defaultdict(Counter)
    for c, t, r, x in rows:
        talks[c][t, "unknown" if r is None else safe(r), safe(x)] += 1
    for c, turns in talks.items():
        order = sorted(turns, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        for who in {k[1] for k in order} - {"system"}:
            parts = defaultdict(list)
            for k in order:
                parts[-1 if k[0] is None else k[0] // chat_format.SEGMENT].append(k)
            for seg, own in parts.items():
                text, spans = "", []
                for t, r, x in own:
                    head = "<|im_start|>" + ("system" if r == "system" else "assistant" if r == who else f"user name={r}") + "\n"
                    if r == who:
                        spans.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(x) + len('<|im_end|>')}")
                    text += head + x + "<|im_end|>\n"
                yield c, who, seg, len(own), sum(turns[k] for k in own), text, ",".join(spans)


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hé 𝄞"), (1, 2, "bob", "<|im_end|>"), (1, 2, "bob", "<|im_end|>"), (1, 3, "cat", None), (1, None, None, "?"), (2, 0, "system", "x"), (None, 1, "ann", "a"), (None, 1, "ann", "b")]
    rows += [(3, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(600)] + [(4, 5, "user", "same")] * 3000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("said", F.lit("clash"))
    got = Counter(tuple(r) for r in chat_format.rotate(df).collect())
    assert got == Counter(brute_rotation(rows))
    for (_, who, _, _, _, text, mask), _ in got.items():
        for span in filter(None, mask.split(",")):
            a, b = map(int, span.split("-"))
            assert text[:a].endswith("<|im_start|>assistant\n") and text[a:b].endswith("<|im_end|>") and text[a:b].count("<|") == 1
    assert chat_format.rotate(df.limit(0)).count() == 0


# ---- source mixing


SIZES = {"a": 900, "b": 400, "c": 37, None: 5}
MIXED = [(i, "t", s) for i, s in enumerate(s for s, n in SIZES.items() for _ in range(n))] + [(3, "t", "a"), (None, "t", "a"), (None, "u", "a")]


@pytest.mark.parametrize("weights", [None, {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1.0}, {"a": 0.998, "b": 0.001, "c": 0.001}, {"a": 0, "b": 1, "c": 3}, {"b": Fraction(1, 3), "c": 2 / 3, "not there": 0.5}])
def test_pfair_deviation_below_one_block(frame, weights):
    """After any number of slots, against the target weights themselves."""
    got = source_mixing.mix(frame(MIXED), weights, slots=40, block=4).collect()
    assert len(got) == len(MIXED)
    assert len({(r.slot, r.place) for r in got}) == len(MIXED)
    n = {"a": 903, "b": 400, "c": 37, "": 5}
    if weights is None:
        targets = {r.source: Fraction(r.tickets, r.slots) for r in source_mixing.tickets(frame(MIXED).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n")), None, 40).collect()}
        assert sum(targets.values()) == 1 and all(abs(float(t) - math.sqrt(n[s]) / sum(map(math.sqrt, n.values()))) < 2 / 40 for s, t in targets.items())
    else:
        targets = {s: Fraction(w).limit_denominator(1000) for s, w in weights.items() if s in n}
        targets = {s: w / sum(targets.values()) for s, w in targets.items()}
    blocks = {r.slot: r.source for r in got}
    last = {s: max(r.slot for r in got if r.source == s) for s in n}
    paid = [s for s in n if targets.get(s)]
    for s in paid:
        seen = 0
        for t in range(last[s] + 1):
            seen += blocks.get(t) == s
            assert abs(targets[s] * (t + 1) - seen) < 1
    end = max(last[s] for s in paid)
    assert all(r.slot > end for r in got if r.source not in paid)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.slot, r.place)):
        by[r.source].append(-1 if r.doc_id is None else r.doc_id)
    assert all(v == sorted(v) for v in by.values())


def test_weights_must_have_a_schedule(frame):
    with pytest.raises(ValueError):
        source_mixing.whole({"a": -1})
    with pytest.raises(ValueError):
        source_mixing.whole({"a": 0.123457, "b": 0.345679, "c": 0.56789 / 7, "d": math.pi / 11})
    assert source_mixing.whole({"a": 0.5, "b": Fraction(1, 4), "c": 0}) == {"a": 2, "b": 1, "c": 0}
    assert source_mixing.whole({}) == {}


def test_mixing_edges(frame):
    assert source_mixing.mix(frame([])).count() == 0
    many = [(i, "t", f"s{i}") for i in range(300)]
    got = source_mixing.mix(frame(many), slots=64, block=2).collect()
    assert len({r.slot for r in got}) == 300


def test_many_sources_by_bundles(frame):
    """More sources than one schedule holds: one slot for each block, and less than two blocks from the targets."""
    rows = [(100 * i + j, "t", f"s{i:03}") for i in range(90) for j in range(1 + i % 37)]
    df = frame(rows)
    shares = source_mixing.tickets(df.groupBy("source").agg(F.count(F.lit(1)).alias("n")), None, 512)
    plan = {r.source: (r.tickets, r.places) for r in source_mixing.period(shares, 1, wide=10).collect()}
    assert sorted(p for _, places in plan.values() for p in places) == list(range(512))
    for n, places in plan.values():
        assert len(places) == n and all(abs(Fraction(n, 512) * (t + 1) - sum(p <= t for p in places)) < 2 for t in range(512))


@pytest.mark.parametrize("many", [100_000, 0])
def test_files_in_mixed_order(spark, frame, many, monkeypatch):
    """With clashing columns, ids that repeat or lack, and either way of placing rows."""
    monkeypatch.setattr(source_mixing, "MANY", many)
    df = frame(MIXED).withColumns({"at": F.lit(1), "slot": F.lit("x"), "_at": F.lit(2), "rank": F.lit(0), "plan": F.lit(1), "Place": F.lit(4), "KEY": F.lit(5)})
    laid = materialize(source_mixing.in_mixed_order(df))
    assert laid.columns == df.columns and laid.count() == len(MIXED)
    have = laid.select("doc_id", "source", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    want = source_mixing.mix(df).orderBy("slot", "place").collect()
    if many:
        assert [(r.doc_id, r.source or "") for r in have] == [(r.doc_id, r.source) for r in want]
    else:  # rows of one id have one slot here
        assert Counter((r.doc_id, r.source or "") for r in have) == Counter((r.doc_id, r.source) for r in want)
        unique = Counter(r.doc_id for r in have)
        assert [r.doc_id for r in have if unique[r.doc_id] == 1] == [r.doc_id for r in want if unique[r.doc_id] == 1]
