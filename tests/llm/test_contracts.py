"""Every registered query over whole tables, against its contract, and every operator with columns of any name."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lemmata.llm import ann, bpe, htmltext, langid, packing, quality, registry, sharding, simhash, tokenfile, tokens, urlfilter
from lemmata.llm.common import read
from test_operators import slow_components, slow_fingerprint, slow_flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def rows_of(spark, n):
    name = next(k for k in registry.QUERIES if k.startswith(f"op{n}_"))
    df = registry.QUERIES[name](spark, SF)
    return df, df.collect()


def kinds(df, **want):
    assert {c: dict(df.dtypes)[c] for c in want} == want


def ids_of(name, texts, end=()):
    t = Tokenizer.from_file(tokens.file_of(name))
    return {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, *end], "<u4") for k, x in texts.items()}


def test_op1(spark, texts):
    df, rows = rows_of(spark, 1)
    kinds(df, doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    want, seqs = ids_of("word_bpe_49k.json", texts, (1,)), defaultdict(list)
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert own.keys() == texts.keys() and sorted(seqs) == list(range(len(seqs)))
    for k, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[k]) and r["ids_crc32"] == zlib.crc32(want[k][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[k])
    for pieces in seqs.values():
        assert len(pieces) == 1 and pieces[0][0] == 0 and pieces[0][1] in {1 << i for i in range(12)}


def test_op2(spark):
    df, rows = rows_of(spark, 2)
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    assert {r["page_id"]: r["text"] for r in rows} == {k: htmltext.extract(h) for k, h in pages.items()} and len(rows) == len(pages)


def test_op3(spark, texts):
    df, rows = rows_of(spark, 3)
    kinds(df, doc_id="bigint", fingerprint="string", component_id="bigint")
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[k]) for k in ids]
    roots = slow_components(fps)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == [(k, f"{f:016x}", ids[c]) for k, f, c in zip(ids, fps, roots, strict=True)]


def test_op4(spark, texts):
    df, rows = rows_of(spark, 4)
    kinds(df, doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and set(slots) <= set(range(40))
    counts = [len(slots.get(i, [])) for i in range(40)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def near_of(sf):
    data = [(i, np.array(v, float)) for i, v in duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall() if v is not None and None not in v]
    data = [(i, v) for i, v in data if np.isfinite(v).all() and v.any()]
    ids, v = np.array([i for i, _ in data]), np.stack([x for _, x in data])
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        out[int(ids[q])] = (dict(zip(ids.tolist(), d.tolist(), strict=True)), set(ids[best].tolist()))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_op5(spark, sf):
    """Recall at the defaults, and every row against brute force."""
    sf = f"/root/testdata/{sf}"
    df = ann.query(spark, sf)
    kinds(df, query_id="bigint", rank="int", vec_id="bigint", score="double")
    got, want = defaultdict(list), near_of(sf)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    hit = 0
    for q, (d, best) in want.items():
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert all(abs(s - d[i]) < 1e-12 for _, s, i in own)
        hit += len(best & {i for _, _, i in own})
    assert hit >= 0.9 * 10 * len(want)


def test_op6(spark, texts):
    df, rows = rows_of(spark, 6)
    kinds(df, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    want, t = ids_of("byte_bpe_50k.json", texts), Tokenizer.from_file(tokens.file_of("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(
        (k, len(x), sha(x.tobytes()), sha(t.decode(x.tolist(), skip_special_tokens=False).encode())) for k, x in want.items()
    )


def test_op7(spark, texts):
    df, rows = rows_of(spark, 7)
    kinds(df, doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 20 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.9


def test_op8(spark):
    """Its SQL on the same table."""
    df, rows = rows_of(spark, 8)
    kinds(df, doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(quality.SQL)
    names = want.columns
    assert set(names) == set(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want.fetchall())


def test_op9(spark):
    """Rules and flows by plain Python over the same pages."""
    df, rows = rows_of(spark, 9)
    kinds(df, page_id="bigint", host="string", path="string", rule="string", verdict="string")
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    seen, arcs, seeds = {}, [], {}
    for k, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("", "") if m is None else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])
        fits = [x for x in urlfilter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        seen[k] = (host, path, rule)
        if rule:
            seeds.setdefault(host, [0, 0])[rule.verdict == "block"] += 1
        arcs += [(host, t.rpartition("@")[2].lower(), 1.0) for t in re.findall(urlfilter.LINK, html or "")]
    hosts = {h for h, _, _ in seen.values() if h}
    pairs = {(".".join(h.split(".")[i:]), ".".join(h.split(".")[i + 1 :])) for h in hosts for i in range(len(h.split(".")) - 2)}
    flows = slow_flows([a for a in arcs if a[0] != a[1]] + [x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))], seeds)
    assert sorted(r["page_id"] for r in rows) == sorted(seen)
    for r in rows:
        host, path, rule = seen[r["page_id"]]
        t, d = flows.get(host, (0, 0))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        own = "block" if d > t * (1 + urlfilter.MARGIN) else "allow"
        assert r["verdict"] == (rule.verdict if rule else own) or (not rule and abs(d - t * (1 + urlfilter.MARGIN)) < 2e-4), r


def test_op10(spark, texts):
    df, rows = rows_of(spark, 10)
    kinds(df, doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    want, at, made = ids_of("byte_bpe_50k.json", texts, (0,)), 0, []
    for k in sorted(texts):
        made.append((k, at, len(want[k]), zlib.crc32(want[k].tobytes())))
        at += len(want[k])
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == made


# --- columns of any name --------------------------------------------------------------

EXTRA = (
    "_text _html _host _hit _gone _fp _group _m _row _rank _base _made fp rid n a b at part score lang_pred shard slot hilbert origin root node class ids v code kind rule verdict said trust distrust "
    "start length ids_crc32 doc_tokens sequence_id offset n_tokens n_words fail_bits component_id a.b w`x tie0 key letter"
).split()
WORDS = "the of and to in which der die und nicht les des est que el los por una".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and long texts, rows without an id, and columns of EXTRA's names."""
    r = np.random.default_rng(3)
    made = [" ".join(r.choice(WORDS, 60)) for _ in range(6)] + [" ".join(r.choice(WORDS, 30000))]
    texts = [(1, made[0]), (1, made[0]), (2, made[0]), (3, made[1]), (3, made[2]), (None, made[3]), (None, made[3]), (None, made[4]), (4, None), (5, ""), (6, made[5]), (7, made[6])]
    rows = [(k, t, "en", f"http://h{i % 3}.org/es/", f"<p>{t}", *(f"{c}{i}" for c in EXTRA)) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, html string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA))


def rows_in(df, names):
    return Counter(map(tuple, df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in names)).collect()))


#: (what to run, rows a row of the table may give, its results); a result whose name is taken ends in an underscore.
OPERATORS = {
    "pack": (lambda d: packing.pack(d, d.columns, longest=1 << 20), [*packing.MADE, "ids", "sequence_id", "offset"]),
    "html": (lambda d: htmltext.visible(d), htmltext.MADE),
    "simhash": (lambda d: simhash.group(d), ["fp", "component_id"]),
    "shard": (lambda d: sharding.assign(d, 3, ["lang", "doc_id", "a.b"], ties=["doc_id", "text"]), sharding.MADE),
    "bpe": (lambda d: bpe.encode(d, d.columns), ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]),
    "language": (lambda d: langid.predict(d, langid.fit(d, steps=5)), langid.MADE),
    "quality": (lambda d: quality.ledger(d), [*quality.MEASURES, "fail_bits"]),
    "url": (lambda d: urlfilter.verdicts(d, d.columns), urlfilter.MADE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(odd, name):
    run, made = OPERATORS[name]
    out = run(odd)
    taken = {c.lower() for c in odd.columns}
    assert out.columns == [*odd.columns, *(f"{m}_" if m in taken else m for m in made)]
    got, want = rows_in(out, odd.columns), rows_in(odd, odd.columns)
    assert got.keys() == want.keys() and (name == "pack" or got == want)
    empty = run(odd.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_files_with_columns_of_any_name(spark, odd, tmp_path):
    listed = tokenfile.write(odd, str(tmp_path / "f"))
    assert tokenfile.read_files(spark, str(tmp_path / "f"), listed).count() == odd.count()
    vectors = odd.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("vec"))
    df = ann.valid(vectors, "doc_id", "vec")
    assert {r["query_id"] for r in ann.search(df, df).collect()} == {1, 2, 3, 4, 5, 6, 7}
    sharding.write_sharded(odd.drop("a.b", "w`x"), str(tmp_path / "s"), 3, ["lang", "doc_id"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows_in(back, odd.drop("a.b", "w`x").columns) == rows_in(odd.drop("a.b", "w`x"), odd.drop("a.b", "w`x").columns)


@pytest.mark.parametrize("at", range(4))
def test_stages_with_columns_of_any_name(spark, odd, at):
    """Rows that stay come back unchanged; a text that shares its doc_id with a copy isn't lost."""
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, SF)
    empty = stage(spark, odd.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "packing":
        assert out.columns == packing.COLUMNS
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    kept, all_ = rows_in(out, odd.columns), rows_in(odd, odd.columns)
    assert all(n <= all_[r] for r, n in kept.items())
    if name.startswith("near-dedup"):
        got = Counter((r[0], r[1]) for r in kept.elements())
        texts = {r[1] for r in all_} - {None}
        assert Counter(t or "" for _, t in got.elements()) == Counter(dict.fromkeys(texts, 1))
        assert all(got[k, t] == 1 for k, t in got) and {k for k, t in got if t and len(t) < 1000} == {1, 3, 6, None}


# --- more cases of single operators ---------------------------------------------------


def test_equal_distances(spark):
    """63 vectors at one distance; the smaller ids win, whatever cells they are in."""
    r = np.random.default_rng(0)
    order = r.permutation(np.arange(1, 64))
    data = [(0, np.eye(64)[0].tolist())] + [(int(i), np.eye(64)[k + 1].tolist()) for k, i in enumerate(order)]
    df = ann.valid(spark.createDataFrame(data, "id long, vec array<double>"), "id", "vec")
    got = ann.search(df, df.where("id = 0"), most=1).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == list(range(1, 11))
    signs = np.sign(r.normal(size=(800, 8)))
    df = ann.valid(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signs)], "id long, vec array<float>"), "id", "vec")
    near = defaultdict(list)
    for x in ann.search(df, df.where("id % 100 = 0"), success=0.999999).orderBy("rank").collect():
        near[x["query_id"]].append(x["vec_id"])
    for q in range(0, 800, 100):
        d = np.sqrt(((signs - signs[q]) ** 2).sum(1))
        d[q] = np.inf
        assert near[q] == np.lexsort((np.arange(800), d))[:10].tolist()


@pytest.mark.parametrize("n", [2, 5, 12])
def test_small_and_uneven_tables(spark, n):
    """Queries get all candidates of a small table, and long vectors find theirs."""
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 16))
    df = ann.valid(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>"), "id", "vec")
    got = Counter(x["query_id"] for x in ann.search(df, df).collect())
    assert got == {i: min(10, n - 1) for i in range(n)}
    v = r.normal(size=(1500, 16)) * np.exp(r.normal(size=(1500, 1)))
    v[::100] *= 30
    df = ann.valid(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>"), "id", "vec")
    found = defaultdict(set)
    for x in ann.search(df, df.where("id % 100 = 0")).collect():
        found[x["query_id"]].add(x["vec_id"])
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
        assert len(found[q]) == 10
    assert hit >= 0.9 * 150


def test_cells_in_blocks(spark, monkeypatch):
    """Small blocks give what large ones give."""
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(400, 4)), 1)
    df = ann.valid(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>"), "id", "vec")
    want = sorted(map(tuple, ann.search(df, df).collect()))
    monkeypatch.setattr(ann, "CELL_ROWS", 5)
    monkeypatch.setattr(ann, "CELL_QUERIES", 4)
    assert sorted(map(tuple, ann.search(df, df).collect())) == want


def test_files_prune(spark, tmp_path):
    """Written shards can be skipped by min/max on each dimension, strings with a long common head too."""
    r = np.random.default_rng(6)
    rows = [(i, f"https://example.org/common/{chr(97 + r.integers(26))}{r.integers(100)}", date(2020, 1, 1 + int(r.integers(28))), int(r.integers(1000))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, url string, day date, size int")
    sharding.write_sharded(df, str(tmp_path / "s"), 64, ["url", "day", "size"], ["id"])
    for c in ("url", "day", "size"):
        spans = duckdb.sql(f"select min({c}), max({c}) from read_parquet('{tmp_path}/s/*/*.parquet', hive_partitioning = true) group by shard").fetchall()
        assert len(spans) == 64
        middle = sorted(x[["id", "url", "day", "size"].index(c)] for x in rows)[3000]
        assert sum(a <= middle <= b for a, b in spans) <= 32, c
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows_in(back, df.columns) == rows_in(df, df.columns)


def test_string_limits(spark):
    """The values at even shares of all rows, one of which has a third of them."""
    r = np.random.default_rng(7)
    values = [f"{x:04d}" for x in r.integers(0, 10**4, 2000)] + ["5000"] * 1000
    df = spark.createDataFrame([(x,) for x in [*values, None, None]], "v string")
    at = [i / 32 for i in range(1, 32)]
    ranked = sorted(values)
    assert sharding._string_limits(df, at, 7) == sorted({ranked[-int(-(x * 3000) // 1) - 1] for x in at})
    assert sharding._string_limits(df.limit(0), at, 7) == []


def test_unknown_tokenizer(tmp_path):
    """A file of another kind isn't cut: the library reads whole texts."""
    import json

    spec = json.loads(tokens.load(tokens.file_of("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["use_regex"] = False
    data = json.dumps(spec).encode()
    e = tokens.Encoder(data)
    assert not e.cuts
    text = "ab ab, ab\n cd" * 3
    assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == Tokenizer.from_buffer(data).encode(text, add_special_tokens=False).ids


def test_rows_that_share_an_id_fill_many_files(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    listed = tokenfile.write(rows, str(tmp_path / "f"), files=4)
    assert len(listed) > 1 and sum(n for _, n, _ in listed) == 400
    assert tokenfile.read_files(spark, str(tmp_path / "f"), listed).count() == 400
