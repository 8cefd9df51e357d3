"""URL rules, archives, quality rules, benchmark passages against plain Python; models on held-out rows."""

import hashlib
import re

import pytest

from tests.llm import data
from tramline.llm import decontaminate, language, quality_model, quality_rules, queries, url_rules, warc

SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_url_rules(spark):
    urls = ["https://WWW.Example.NET/en/a?b", "http://a.net", "x://net/", "https://example.com/de/x#y", "https://notexample.com/de/", "http://b.org/fr/", "http://b.org/FR/", "nothing", "", None, "://", "a://b://net/", "http://example.net/e"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    folder = url_rules.build_rules(url_rules.rules_frame(spark, queries.URL_RULES))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(df, folder, "page_id", "url").collect()), key=str)

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = lower(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow")))

    assert got == sorted(((i, *judged(u)) for i, u in rows), key=str)
    assert url_rules.apply_rules(df.limit(0), folder, "page_id", "url").count() == 0


def test_archives_come_back(spark):
    bodies = ["x" * 100, "x" * 99, "é" * 60, None, "", "y" * 5000]
    rows = [(i, f"http://a/{i}\r\nX: y", bodies[i % 6]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archive(spark, warc.write_archive(pages, 5, roll_bytes=2000)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, body in rows:
        raw = (body or "").encode()
        own = first.setdefault(raw, i) if len(raw) >= 100 else i
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if own == i else "revisit", None if own == i else own)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), 3)).count() == 0


def test_odd_rules_and_urls(spark):
    rules = [("Example.NET", "/a\nb", "block"), ("a", "/", None), (None, "/", "block"), ("b", None, "block"), ("c.org", "/", "x\ny"), ("c.org", "/", "a"), ("", "", "allow"), ("12:q", "/", "block")]
    folder = url_rules.build_rules(url_rules.rules_frame(spark, rules), files=3)
    urls = ["h://www.example.net/a\nbc", "h://a/", "h://b/", "h://C.org/", "h://12:q/z", "h://d/" + "p" * 200_000]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.apply_rules(df, folder, "page_id", "url").collect()}
    assert got == {0: ("Example.NET/a\nb".lower(), "block"), 1: (None, "allow"), 2: (None, "allow"), 3: ("c.org/", "a"), 4: ("12:q/", "block"), 5: (None, "allow")}
    none = url_rules.build_rules(url_rules.rules_frame(spark, []))
    assert {r.verdict for r in url_rules.apply_rules(df, none, "page_id", "url").collect()} == {"allow"}


def test_shards_of_an_archive_are_even(spark):
    from pyspark.sql import functions as F

    r = __import__("random").Random(6)
    rows = [(k * k if k % 4 else 77 if k % 8 else None, f"http://a/{k}", "".join(r.choice("abcdef <>") for _ in range(r.choice([50, 400, 900])))) for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sized = warc.plan_records(pages)[1].select(warc._place().alias("place"), F.col("size").alias("n"))
    for shards in (2, 12, 40):
        cuts = warc._splitters(sized, shards)
        assert len(cuts) == shards - 1
        places = sorted((x.place.none, x.place.id, x.place.tie, x.n) for x in sized.collect())
        at = [(c["none"], c["id"], c["tie"]) for c in cuts]
        sizes = [0] * shards
        for *p, n in places:
            sizes[sum(c <= tuple(p) for c in at)] += n
        assert max(sizes) < 1.2 * sum(sizes) / shards and min(sizes) > 0.8 * sum(sizes) / shards
    again = pages.unionByName(pages.limit(5))
    got = warc.read_archive(spark, warc.write_archive(again.withColumn("digest", F.lit("clash")).withColumn("shard", F.lit("clash")), 12))
    own = [(a, b) for a, _, b in rows + rows[:5]]
    assert sorted(((x.page_id, x.payload_digest) for x in got.collect()), key=str) == sorted(((a, hashlib.sha256(b.encode()).hexdigest()) for a, b in own), key=str)


def test_ledger_policies_ablations_and_groups(spark):
    df = data.frame(spark, 3)
    entries = quality_rules.ledger(df.select("doc_id", "text"))
    stored = entries.join(df.select("doc_id", "source"), "doc_id")
    rows = stored.collect()
    fails = {
        "few_words": lambda r: r.n_words < 50, "repeated_words": lambda r: 100 * r.n_repeat_words > 50 * r.n_words, "symbols": lambda r: 10 * r.n_symbols > r.n_words, "repeated_lines": lambda r: 2 * r.n_dup_lines > r.n_lines,
        "word_length": lambda r: r.n_words > 0 and not 3 * r.n_words <= r.word_chars <= 12 * r.n_words, "capitals": lambda r: r.word_chars > 0 and 10 * r.n_capitals > 4 * r.word_chars,
    }
    bits = {r.doc_id: sum(1 << k for k, f in enumerate(fails.values()) if f(r)) for r in rows}
    assert {r.doc_id: r.failure_bits for r in rows} == bits
    for policy in (quality_rules.BASE, quality_rules.STRICT):
        mask = policy.mask()
        assert {r.doc_id: r.kept for r in quality_rules.judge(stored, policy).collect()} == {i: not b & mask for i, b in bits.items()}
        want = {name: (sum(bool(b >> k & 1) for b in bits.values()), sum(b & mask == 1 << k for b in bits.values())) for k, name in enumerate(fails) if name in policy.rules}
        got = {r.rule: (r.failed, r.rejected_alone) for r in quality_rules.ablate(stored, policy).collect()}
        assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and all(v == (0, 0) for k, v in want.items() if k not in got)
    for r in quality_rules.by_group(stored, "source").collect():
        own = [bits[x.doc_id] for x in rows if x.source == r.source]
        any_, all_ = 0, -1
        for b in own:
            any_, all_ = any_ | b, all_ & b
        assert (r.any_bits, r.all_bits, r.n) == (any_, all_, len(own))
    kept = quality_rules.keep(df)
    assert {r.doc_id for r in kept.collect()} == {i for i, b in bits.items() if not b} and kept.columns == df.columns


def test_quality_measures(spark):
    df = data.frame(spark, 3, awkward=True)

    def measured(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {k + o for at in seen.values() if len(at) > 1 for k in at for o in range(3)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    entries = quality_rules.ledger(df.select("doc_id", "text"))
    judged = quality_rules.judge(entries, quality_rules.BASE)
    got = sorted(((r.doc_id, *(r[n] for n in names), r.kept) for r in judged.collect()), key=str)
    want = []
    for r in df.collect():
        m = measured(r.text)
        want.append((r.doc_id, *m, not (m[0] < 50 or 100 * m[4] > 50 * m[0])))
    assert got == sorted(want, key=str)
    assert quality_rules.keep(df.limit(0)).count() == 0


def test_benchmark_passages(spark):
    df = data.frame(spark, 4, awkward=True)
    texts = [r.text for r in df.collect() if r.text and len(r.text.split()) > 40]
    items = [("a", texts[1][20:300]), ("b", texts[2][:200].upper()), ("c", "one two"), ("d", None), ("e", "  "), ("f", texts[3]), ("f2", texts[3])]
    tests = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def hits(text):
        ws, hit, found = word.findall(lower(text)), set(), set()
        for item, t in items:
            iw = word.findall(lower(t))
            n = min(13, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        return len(ws), len(hit), sorted(found)

    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.match(df, tests).collect()), key=str)
    assert got == sorted(((r.doc_id, *hits(r.text)) for r in df.collect()), key=str)
    assert sum(x[2] for x in got) > 0
    kept = decontaminate.clean(df, tests)
    assert kept.columns == df.columns
    assert kept.count() == sum(not (h > 0 and 20 * h >= n) for _, n, h, _ in got)
    assert decontaminate.match(df, tests.limit(0)).filter("n_hit > 0").count() == 0


def test_language_on_held_out_rows(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = queries.op10_language(spark, SF).join(lang, "doc_id").collect()
    assert len(rows) == lang.count()
    judged = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang and r.text and len(r.text.split()) >= 20]
    assert len(judged) > 50 and sum(judged) > 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in rows)
    model = language.train(lang.filter("doc_id % 2 = 0"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "a" * 50_000), (None, "é")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and "und" not in (got[4], got[None])


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op9_quality_model(spark, SF).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8
    odd = quality_model.feature_table(data.frame(spark, 5, awkward=True))
    model = quality_model.train(odd, spark.createDataFrame([(8, 1), (9, 0), (10, 1)], "doc_id long, quality int"), "doc_id", "quality")
    scored = quality_model.score(odd, model).collect()
    assert len(scored) == data.frame(spark, 5, awkward=True).count() and all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_chain(spark, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert docs.count() <= before
        before = docs.count()
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    sizes = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    assert {r.doc_id: r.n_bytes for r in coded.collect()} == sizes and (empty or sizes)
