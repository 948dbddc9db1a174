"""Parser, store, search and tools."""

import contextlib
import sys
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmata import render
from lemmata.engine import Engine
from lemmata.functions import blocks as B
from lemmata.functions import query as Q
from lemmata.operators import cells
from lemmata.operators import search as searching
from lemmata.operators.embed import Embedder, HashingModel, mean_pool
from lemmata.plans import blocks as plans
from lemmata.operators.embed import MaskedMeanModel, SentenceModel, normalized
from lemmata.operators.store import bucket_of
from lemmata.sources import latex, tex
from lemmata.sources.charset import decode

SMALL = Embedder(HashingModel(16), HashingModel(8))

PAPER = r"""\documentclass{article}
\begin{document}
\section{Limits}
% \begin{lemma} not here \end{lemma}
\begin{defn}[Limit]\label{def:lim} A number $L$ \end{defn}
\begin{thm}
  \begin{equation}\label{eq:no}x\end{equation}
  \label{thm:sq} Squeeze
  \begin{lemma} inner \end{lemma}
\end{thm}
{\begin{claim} hidden \end{claim}}
\begin{center}\subsection*{Starred}\begin{proof} By it. \end{proof}\end{center}
\begin{verbatim}\begin{lemma}x\end{lemma}\end{verbatim}
\begin{theorem*} no \end{theorem*}
\begin{remark} never closed
\begin{ex} Last \end{ex}
\end{document}
"""


def rows(source):
    return [(k, n, t, label) for _, k, n, t, label, _ in latex.events(source)]


def test_events():
    assert rows(PAPER) == [
        ("section", "section", "Limits", ""),
        ("block", "defn", "", "def:lim"),
        ("block", "thm", "", "thm:sq"),
        ("section", "subsection", "*", ""),
        ("block", "proof", "", ""),
        ("block", "ex", "", ""),
    ]
    body = [e[5] for e in latex.events(PAPER) if e[1] == "block"][0]
    assert body == r"\begin{defn}[Limit]\label{def:lim} A number $L$ \end{defn}"
    assert rows("") == [] and rows(r"\end{lemma}}$") == []
    assert rows(r"\section[S]{L}") == [("section", "section", "[S]", "")]
    assert rows(r"\section{Foo {bar}}") == [("section", "section", "Foo {bar", "")]
    assert rows(r"\[ \begin{lemma}x\end{lemma} \] \begin{lemma}{\label{a}}\label{b}\label{c}\end{lemma}") == [("block", "lemma", "", "b")]


def test_decode():
    text = "定義 x"
    assert all(decode(text.encode(c)) == text for c in ("utf-8", "utf-8-sig", "euc_jp", "shift_jis", "iso2022_jp", "utf-16", "utf-32"))
    assert "�" in decode(b"\xff\xff\x00\xfe") and decode(b"") == ""


@pytest.mark.parametrize(
    ("text", "charsets"),
    [
        ("\\begin{theorem}Cela vaut déjà\\end{theorem}", "latin_1 cp1252"), ("\\section{Théorème générale} L'œuvre créée", "cp1252"), ("Satz von Weierstraß: für jede Folge", "latin_1"),
        ("Größe über naïve Maße, “quoted” – Übung", "cp1252"), ("É. Cartan", "latin_1"), ("señal: ¿qué es una función?", "latin_1"), ("Let f be continuous.", "utf-16-le utf-16-be"),
        ("定理。コンパクト性の定義を述べる。", "euc_jp shift_jis iso2022_jp"), ("集合 A の元", "euc_jp shift_jis"), ("Теорема о пределе. Пусть дана", "cp1251 koi8_r iso8859_5"),
        ("定理：每个有限群都同构于置换群的子群。", "gb18030 gb2312"), ("紧致", "gb18030"), ("\\begin{theorem}设 $f$ 可微，则 $f$ 连续\\end{theorem}", "gb18030"), ("定理：每個有限群都同構於置換群的子群。", "big5"),
        ("\\section{拓撲空間} 開集", "big5"), ("函數", "big5"), ("函数", "gb18030"), ("関数", "euc_jp shift_jis"), ("정리: 모든 유한군은 치환군의 부분군과 동형이다.", "euc_kr"), ("함수", "euc_kr"),
        ("Θεώρημα του Πυθαγόρα: σε κάθε ορθογώνιο τρίγωνο", "iso8859_7"), ("\\section{Σύνολα} Ορισμός", "iso8859_7 cp1253"), ("ΘΕΩΡΗΜΑ", "iso8859_7"), ("משפט פיתגורס: בכל משולש ישר זווית", "iso8859_8 cp1255"),
        ("\\section{קבוצות} הגדרה", "iso8859_8"), ("مبرهنة فيثاغورس: في كل مثلث قائم الزاوية", "cp1256 iso8859_6"), ("\\section{المجموعات} تعريف", "cp1256"), ("Różniczka i całka", "cp1250 iso8859_2"),
        ("Twierdzenie Pitagorasa: w każdym trójkącie prostokątnym pole się równa", "cp1250 iso8859_2"), ("Věta: každý trojúhelník má součet úhlů", "cp1250 iso8859_2"), ("Erdős problem", "cp1250"), ("Łukasiewicz", "cp1250 iso8859_2"),
        ("Pitagorasz tétele: minden derékszögű háromszögben", "cp1250 iso8859_2"), ("Definição: função contínua", "latin_1"), ("Hölder's inequality", "cp1252"), ("naïve", "latin_1"), ("Лемма", "cp1251 koi8_r"),
    ],
)
def test_charsets(text, charsets):
    for c in charsets.split():
        assert decode(text.encode(c)) == text, c


def test_latin_1_folder(spark, tmp_path):
    (tmp_path / "fr.tex").write_bytes("\\section{Théorème}\\begin{theorem}Cela vaut déjà\\end{theorem}".encode("latin_1"))
    (tmp_path / "de.tex").write_bytes("\\begin{lemma}Für große Maße\\end{lemma}".encode("latin_1"))
    got = {r.env_type: (r.section, r.text) for r in plans.of_folder(spark, f"file://{tmp_path}").collect()}
    assert got == {"theorem": ("Théorème", "\\begin{theorem}Cela vaut déjà\\end{theorem}"), "lemma": ("", "\\begin{lemma}Für große Maße\\end{lemma}")}


def test_places(monkeypatch):
    assert tex.resolved("s3://bucket/a/../b.tex") == "s3://bucket/b.tex" and tex.resolved("file:///x/../y") == "/y"
    assert tex.place("/a/b")[1:] == ("/a/b", "") and tex.place("file:///a/b")[1:] == ("/a/b", "file://")


def test_unparsed_files(spark, monkeypatch):
    """A file that fails gives an error row and no block; the others are read."""
    files = spark.createDataFrame([("/a.tex", "\\begin{lemma}x\\end{lemma}", 0), ("/b.tex", None, 1)], "path string, text string, file_ord long")
    assert [(r.source_file, r.kind, r.body) for r in tex.parsed(files, "/").collect()] == [("/a.tex", "block", "\\begin{lemma}x\\end{lemma}")]

    def broken(text):
        yield 0, "section", "section", "before", "", ""
        raise ValueError("no")

    monkeypatch.setattr(latex, "events", broken)
    assert list(latex.latex_events.func().eval("x")) == [(1, 0, "error", "ValueError", "no", "", "")]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "p"
    (root / "a").mkdir(parents=True)
    (root / "a-b.tex").write_text("\\begin{lemma}dash\\end{lemma}")
    (root / "a" / "b.tex").write_text("\\section{A}\\input{../z} \\input{b}\\begin{lem}first\\end{lem}")
    (root / "z.tex").write_text("\\begin{lemma}\\label{l:z}z\\end{lemma}\\include{missing}")
    (root / "_h.tex").write_bytes("\\begin{theorem}定理\\end{theorem}".encode("euc_jp"))
    (root / "none.tex").write_text("no blocks")
    return root


def test_folder_order_and_ids(spark, folder):
    got = plans.of_folder(spark, str(folder)).orderBy("file_ord", "pos").collect()
    assert [(r.block_id, r.section) for r in got] == [("_h.tex::theorem::1", ""), ("b.tex::lemma::1", "A"), ("z.tex::lemma::2", ""), ("a-b.tex::lemma::3", "")]
    assert plans.of_file(spark, str(folder / "z.tex")).first().block_id == "z.tex::lemma::1"
    with pytest.raises(ValueError, match="Not a directory"):
        tex.directory(folder / "none.tex")


def test_includes_outside_the_folder(spark, tmp_path):
    """Rounds of includes that no listing names, a cycle back, a link to a directory, a folder's own link to a file."""
    for name in ("p/sub", "lib"):
        (tmp_path / name).mkdir(parents=True)
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("p/main.tex", "\\input{../lib/a}\\begin{lemma}main\\end{lemma}\\input{gone}\\input{../lib/plain.v2}")
    write("p/sub/last.tex", "\\input{../main}\\begin{lemma}last\\end{lemma}")
    write("lib/a.tex", "\\include{ b }\\begin{lemma}a\\end{lemma}")
    write("lib/b.tex", "\\input{../p/main}\\input{a}\\begin{lemma}b\\end{lemma}")
    write("lib/plain.v2", "\\begin{claim}plain\\end{claim}")
    (tmp_path / "p" / "link").symlink_to(tmp_path / "lib")
    (tmp_path / "p" / "a-link.tex").symlink_to(tmp_path / "lib" / "b.tex")
    held = []
    got = tex.ordered(spark, str(tmp_path / "p"), held).orderBy("file_ord").select("path").collect()
    assert [r.path.removeprefix(f"{tmp_path}/") for r in got] == ["lib/b.tex", "p/main.tex", "lib/a.tex", "lib/plain.v2", "p/sub/last.tex"]
    ids = [r.block_id for r in plans.of_folder(spark, str(tmp_path / "p"), held).orderBy("file_ord", "pos").collect()]
    assert ids == ["b.tex::lemma::1", "main.tex::lemma::2", "a.tex::lemma::3", "plain.v2::claim::1", "last.tex::lemma::4"]
    for x in held:
        x.unpersist()
    (tmp_path / "empty").mkdir()
    assert plans.of_folder(spark, str(tmp_path / "empty")).isEmpty()


def test_numbers_in_order(spark):
    held = []
    df = spark.createDataFrame([(f"/a/{i % 7}/{i}",) for i in range(500)], "path string").repartition(7)
    got = [r["path"] for r in tex.placed(df, [F.split("path", "/")], held).orderBy("place").collect()]
    assert got == sorted((f"/a/{i % 7}/{i}" for i in range(500)), key=lambda p: p.split("/"))
    assert [r["place"] for r in tex.placed(df, ["path"], held).select("place").orderBy("place").collect()] == list(range(500))
    for x in held:
        x.unpersist()


def test_tools(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), SMALL)
    assert e.dispatch("list_folders", {}) == "No folders indexed yet."
    assert e.dispatch("search", {"query": "x"}) == "No results found."
    path = str(folder)
    for _ in range(2):  # again: the same rows
        assert e.dispatch("index_folder", {"folder_path": path}) == f"Indexed 4 file(s), 4 block(s) from {path}."
    assert e.dispatch("list_folders", {}) == f"Indexed folders:\n  {path}  (4 file(s), 4 block(s))"
    assert e.dispatch("get_by_label", {"label": "l:z"}) == f"LEMMA  (label: l:z)\n  file: {path}/z.tex\n  ---\n\\begin{{lemma}}\\label{{l:z}}z\\end{{lemma}}"
    assert e.dispatch("get_by_label", {"label": "q", "folder_path": "/n"}) == "No block with label 'q' found in /n."
    assert e.get_by_label("").first().block_id == "_h.tex::theorem::1"
    hits = e.search("first lemma", n_results=2).collect()
    assert len(hits) == 2 and hits[0].score >= hits[1].score and hits[0].matched_view == "text"
    assert e.search("first", env_type="lem").isEmpty() and not e.search("first", env_type="").isEmpty()
    assert e.search("$x$", n_results=0).isEmpty()
    assert e.dispatch("remove_folder", {"folder_path": "/n"}) == "No indexed blocks found for /n."
    assert e.dispatch("remove_folder", {"folder_path": path}) == f"Removed 4 block(s) from {path}."
    with pytest.raises(ValueError, match="Unknown tool: x"):
        e.dispatch("x", {})
    with pytest.raises(KeyError):
        e.dispatch("search", {})
    assert e.call("x", {}).startswith("Error:\nTraceback")
    assert [t["name"] for t in e.list_tools()] == ["index_folder", "search", "get_by_label", "list_folders", "remove_folder"]


def test_stale_rows_and_collisions(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), SMALL)
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "main.tex").write_text("\\begin{lemma}" + name + "\\end{lemma}")
    e.index_folder(str(tmp_path / "x"))
    e.index_folder(str(tmp_path / "y"))
    assert [r.folder for r in e.list_folders().collect()] == [str(tmp_path / "y")]
    (tmp_path / "y" / "main.tex").write_text("nothing")
    assert e.dispatch("index_folder", {"folder_path": str(tmp_path / "y")}).startswith("No theorem-like blocks")
    assert e.store.read().count() == 1


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("definition of compactness", "TEXT"), ("開集合の定義", "TEXT"), ("", "TEXT"), (r"$\alpha$", "MATH"), (r"\int_a^b f(x)\, dx", "MATH"),
        (r"continuity of $f$", "MIXED"), ("of$x$a", "MIXED"), (r"\(foo\)", "MIXED"), ("costs $5 and $6", "MATH"), (r"$x_{٣}$ ٣٤٥", "MATH"),
    ],
)
def test_query_type(spark, query, kind):
    # "costs" is a word that stays
    want = "MIXED" if query.startswith("costs") else kind
    assert spark.createDataFrame([(query,)], "q string").select(Q.query_type(F.col("q"))).first()[0] == want


def test_boost_words(spark):
    said = ["definition of x", "Define y", "the meaning", "definitions", "theorem"]
    got = spark.createDataFrame([(s,) for s in said], "q string").select(Q.wants_definitions(F.col("q"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_ranking(spark):
    kind = "query_id int, boost boolean, block_id string, env_type string, view_ord int, score double, view_rank int"
    data = [(0, True, "t", "theorem", 0, 1.0, 1), (0, True, "d1", "definition", 0, 0.9, 2), (0, True, "d2", "definition", 1, 0.95, 1), (0, True, "n", "definition", 1, -0.2, 2)]
    got = searching.ranked(searching.merged(spark.createDataFrame(data, kind)), 9).orderBy("rank").collect()
    assert [(r.block_id, round(r.score, 9)) for r in got] == [("t", 1.0), ("d1", 1.0), ("d2", 1.0), ("n", -0.23)]


def test_embedding(spark):
    hidden, mask = np.array([[[1.0, 2], [3, 4], [9, 9]]]), np.array([[1, 1, 0]])
    assert mean_pool(hidden, mask).tolist() == [[2, 3]] and mean_pool(hidden, mask * 0).tolist() == [[0, 0]]
    q = SMALL.queries(spark.createDataFrame([("words here",), ("$x$",), ("words $x$",)], "query string")).collect()
    assert [(r.query_type, r.text_vec is None, r.math_vec is None) for r in q] == [("TEXT", False, True), ("MATH", True, False), ("MIXED", False, False)]
    assert abs(np.linalg.norm(q[0].text_vec) - 1) < 1e-6 and len(q[0].text_vec) == 16


def test_models(monkeypatch):
    """The adapters on packages of their interface: device, prompt, masked mean over at most 512 tokens."""
    seen = {}

    class Tensor:
        def __init__(self, x):
            self.x = np.asarray(x)

        def cpu(self):
            return self

        def numpy(self):
            return self.x

    class Batch(dict):
        def to(self, where):
            seen["batch on"] = where
            return self

    class Split:
        @classmethod
        def from_pretrained(cls, name):
            return cls()

        def __call__(self, texts, padding, truncation, max_length, return_tensors):
            rows = [t.split()[:max_length] for t in texts]
            n = max(map(len, rows))
            seen["tokens"] = n
            return Batch(input_ids=Tensor([[len(w) for w in r] + [0] * (n - len(r)) for r in rows]), attention_mask=Tensor([[1] * len(r) + [0] * (n - len(r)) for r in rows]))

    class Model(Split):
        def to(self, where):
            seen["model on"] = where
            return self

        def eval(self):
            seen["eval"] = True

        def __call__(self, input_ids, attention_mask):
            return SimpleNamespace(last_hidden_state=Tensor(np.stack([input_ids.x, input_ids.x + 1], axis=2)))

    class Sentence:
        def __init__(self, name, device):
            seen["sentence on"] = device

        def encode(self, texts, batch_size, normalize_embeddings, convert_to_numpy):
            return np.array([[len(t), 1.0] for t in texts])

    torch = SimpleNamespace(cuda=SimpleNamespace(is_available=lambda: False), backends=SimpleNamespace(mps=SimpleNamespace(is_available=lambda: True)), no_grad=contextlib.nullcontext)
    for name, module in {"torch": torch, "transformers": SimpleNamespace(AutoModel=Model, AutoTokenizer=Split), "sentence_transformers": SimpleNamespace(SentenceTransformer=Sentence)}.items():
        monkeypatch.setitem(sys.modules, name, module)
    got = MaskedMeanModel("m", batch=2)()(["a bbb", "cc", "d " * 900])
    assert got.tolist() == [[2, 3], [2, 3], [1, 2]] and seen["tokens"] == 512 and seen["model on"] == seen["batch on"] == "mps" and seen["eval"]
    assert SentenceModel("s", on="cpu")()(["abc"]).tolist() == [[3, 1]] and seen["sentence on"] == "cpu"
    made = HashingModel(32)()(["", "ab", "abcd", "abcd"])
    assert made.shape == (4, 32) and (made[2] == made[3]).all() and (normalized(np.zeros((1, 2))) == 0).all()


def test_search_leaves_out_what_has_no_direction(spark, monkeypatch):
    """Zero, null and other-length vectors, in blocks and queries; more queries than one pass takes."""
    kind = "block_id string, env_type string, text_vec array<float>, math_vec array<float>"
    blocks = spark.createDataFrame([("a", "lemma", [1.0, 0.0], None), ("b", "lemma", [0.0, 0.0], [0.0]), ("c", "lemma", [1.0, 1.0], [2.0]), ("d", "lemma", [1.0, 0.0, 0.0], None), ("e", "lemma", None, [float("nan")])], kind)
    asked = spark.createDataFrame([(0, False, [2.0, 0.0], [1.0]), (1, False, [0.0, 0.0], None), (2, False, [0.0, 3.0], None)], "query_id int, boost boolean, text_vec array<double>, math_vec array<double>")
    got = [(r.query_id, r["rank"], r.block_id, round(r.score, 6), r.matched_view) for r in searching.search(blocks, asked, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, "a", 1.0, "text"), (0, 2, "c", 1.0, "both"), (2, 1, "c", 0.707107, "text"), (2, 2, "a", 0.0, "text")]
    for how in ("parts", "few"):
        monkeypatch.setattr(searching, "SIDE", 1)
        again = searching.search(blocks, asked, 3, few=how == "few").orderBy("query_id", "rank").collect()
        assert [(r.query_id, r["rank"], r.block_id, round(r.score, 6), r.matched_view) for r in again] == got


def test_search_plan_is_the_same_for_any_number(spark):
    """No job runs while a search is put together, and its plan doesn't grow with the queries."""
    blocks = spark.range(1000).selectExpr("cast(id as string) as block_id", "'lemma' as env_type", "array(cos(id), sin(id)) as text_vec", "array(sin(id), 1.0D) as math_vec")
    sizes = []
    for n in (5, 50_000):
        asked = spark.range(n).selectExpr("id as query_id", "id % 2 = 0 as boost", "array(sin(id), cos(id)) as text_vec", "if(id % 3 = 0, array(1.0D, sin(id)), null) as math_vec")
        spark.sparkContext.setJobGroup(f"build-{n}", "")
        found = searching.search(blocks, asked, 2)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{n}")
        sizes.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    spark.sparkContext.setJobGroup("", "")
    assert sizes[0] == sizes[1]


def test_search_in_many_cells(spark, monkeypatch):
    """A grid of several blocks and query parts against brute force."""
    monkeypatch.setattr(searching, "SIDE", 40)
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(300, 6)).round(1), rng.normal(size=(90, 6)).round(1)
    blocks = spark.createDataFrame([(i, "lemma", x.tolist(), None) for i, x in enumerate(v)], "block_id long, env_type string, text_vec array<double>, math_vec array<double>")
    asked = spark.createDataFrame([(i, False, x.tolist(), None) for i, x in enumerate(q)], "query_id long, boost boolean, text_vec array<double>, math_vec array<double>")
    got = {}
    for r in searching.candidates(blocks, asked, 4).orderBy("query_id", "view_rank").collect():
        got.setdefault(r.query_id, []).append(r.block_id)
    score = (normalized(q) @ normalized(v).T).round(12)
    assert got == {i: np.lexsort((np.arange(300), -s))[:8].tolist() for i, s in enumerate(score)}


def test_search_holds_few_hits(spark, monkeypatch):
    """However large n is, a cell has so few queries that it holds HELD hits at most; the results stay."""
    for keep in (1, 10, 800, 5000, searching.HELD, 10 * searching.HELD):
        rows, asked = searching.sides(keep)
        assert min(rows, keep) * asked <= searching.HELD
    assert searching.sides(10) == (searching.SIDE, searching.SIDE)
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(300, 6)), rng.normal(size=(90, 6))
    blocks = spark.createDataFrame([(i, "lemma", x.tolist(), None) for i, x in enumerate(v)], "block_id long, env_type string, text_vec array<double>, math_vec array<double>")
    asked = spark.createDataFrame([(i, False, x.tolist(), None) for i, x in enumerate(q)], "query_id long, boost boolean, text_vec array<double>, math_vec array<double>")
    score = normalized(q) @ normalized(v).T
    monkeypatch.setattr(searching, "SIDE", 60)
    for held in (20, 1000):
        monkeypatch.setattr(searching, "HELD", held)
        got = {}
        for r in searching.candidates(blocks, asked, 50).orderBy("query_id", "view_rank").collect():
            got.setdefault(r.query_id, []).append(r.block_id)
        assert got == {i: np.lexsort((np.arange(300), -s))[:100].tolist() for i, s in enumerate(score)}


def clustered(spark, n=4000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    v = normalized(centre[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, dim)))
    rows = [(f"b{i}", "definition" if i % 9 == 0 else "lemma", f"/f{i % 4}", x.tolist(), x[: dim // 2].tolist() if i % 2 else None) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "block_id string, env_type string, folder string, text_vec array<double>, math_vec array<double>")


def test_index(spark):
    """Recall and exact scores; a filter that leaves few is exact; what has no direction has no cell."""
    v, blocks = clustered(spark)
    index = cells.Index(cells.fit(blocks))
    cached = index.assigned(blocks).cache()
    assert index.probes[0] < len(index.centre[0]) / 4 and cached.where("math_vec is null and math_cell is not null").isEmpty()
    asked = spark.createDataFrame([(i, False, v[i].tolist(), None) for i in range(0, 4000, 40)], "query_id long, boost boolean, text_vec array<double>, math_vec array<double>")
    near = cells.candidates(cached, index, asked, 5).collect()
    want = {(r.query_id, r.block_id): r.score for r in searching.candidates(blocks, asked, 5).collect()}
    hits = [r for r in near if (r.query_id, r.block_id) in want]
    assert len(near) == 1000 and len(hits) >= 0.9 * len(want) and all(r.score == want[r.query_id, r.block_id] for r in hits)
    scope = F.col("block_id").isin("b3", "b77", "b1500")
    few = cells.search(cached, index, asked, 5, scope).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, searching.search(blocks, asked, 5, scope).collect())) and len(few) == 300
    cached.unpersist()
    empty = blocks.limit(0)
    none = cells.Index(cells.fit(empty))
    assert cells.search(none.assigned(empty), none, asked, 5).isEmpty()
    # an index without cells: every query is compared with all blocks
    assert sorted(map(tuple, cells.search(none.assigned(blocks), none, asked, 5).collect())) == sorted(map(tuple, searching.search(blocks, asked, 5).collect()))


def test_store_index(spark, tmp_path):
    """An engine with an index: new blocks get cells, filters are exact."""
    e = Engine(spark, str(tmp_path / "db"), SMALL)
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.tex").write_text("".join(f"\\begin{{lemma}} {name} number {i} {'word ' * (i % 5)}\\end{{lemma}}" for i in range(60)))
    e.index_folder(str(tmp_path / "x"))
    before = [tuple(r) for r in e.search("number 7", n_results=3).collect()]
    e.build_index()
    assert e.store.read().where("text_cell is null").isEmpty()
    assert [tuple(r) for r in e.search("number 7", n_results=3).collect()][0] == before[0]
    e.index_folder(str(tmp_path / "y"))
    assert e.store.read().where("text_cell is null").isEmpty() and e.store.read().count() == 120
    hits = e.search("number 7", folder_path=str(tmp_path / "y"), n_results=50)
    assert {r.folder for r in hits.collect()} == {str(tmp_path / "y")}
    # texts are read from the parts that hits are in
    assert "dynamicpruning" in e.search("number 7")._jdf.queryExecution().executedPlan().toString()


def block_rows(spark, ids, folder, label="", file="/f"):
    return spark.createDataFrame([("lemma", f"t{i}", label and f"{label}{k}", "", file, folder, i, [1.0], [1.0], k) for k, i in enumerate(ids)], "env_type string, text string, label string, section string, source_file string, folder string, block_id string, text_vec array<float>, math_vec array<float>, _ord long")


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def counts_equal_scan(store):
    scan = sorted(tuple(r) for r in store.read().groupBy("folder").agg(F.count_distinct("source_file"), F.count("*")).collect())
    assert [tuple(r) for r in store.list_folders().collect()] == scan


def test_store_writes_what_a_change_touches(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "db"), SMALL).store
    every = block_rows(spark, [f"a{i}" for i in range(4000)], "x").withColumn("folder", F.concat(F.lit("/p/"), (F.col("_ord") % 20).cast("string")))
    store.upsert(every)
    blocks = tmp_path / "db" / "blocks"
    first = files_of(blocks)
    assert len({f.split("/")[0] for f in first}) == 20
    # a folder of its own: nothing else is written
    store.upsert(block_rows(spark, [f"n{i}" for i in range(300)], "/new"))
    second = files_of(blocks)
    assert {f for f in first if second.get(f) != first[f]} == set() and len({f.split("/")[0] for f in set(second) - set(first)}) == 1
    counts_equal_scan(store)
    # ids of two other folders: these, and the own one
    ids = [f"a{i}" for i in range(4000) if i % 20 in (3, 4)][:300]
    store.upsert(block_rows(spark, [*ids, "n5"], "/new", label="l"))
    third = files_of(blocks)
    changed = {f.split("/")[0] for f in second if third.get(f) != second[f]}
    assert len(changed) == 3 and store.read().count() == 4300
    seq = {r.block_id: r.seq for r in store.read().collect()}
    assert seq["n5"] == 4005 and seq[ids[0]] == int(ids[0][1:]) and len(set(seq.values())) == 4300
    counts_equal_scan(store)
    # all ids of a folder: it is gone
    ids = [f"a{i}" for i in range(4000) if i % 20 == 7]
    store.upsert(block_rows(spark, ids, "/new"))
    assert store.read("/p/7").isEmpty() and "/p/7" not in {r.folder for r in store.list_folders().collect()}
    counts_equal_scan(store)
    # a removal deletes a directory and writes nothing
    before = files_of(tmp_path / "db")
    assert store.remove_folder("/new") == 300 + 300 + 200
    after = files_of(tmp_path / "db")
    assert set(after) < set(before) and all(after[f] == before[f] for f in after) and store.remove_folder("/new") == 0
    counts_equal_scan(store)
    assert not list((tmp_path / "db").glob("staging-*"))


def test_store_reads_by_folder_and_label(spark, tmp_path):
    store = Engine(spark, str(tmp_path / "db"), SMALL).store
    for k in range(3):
        store.upsert(block_rows(spark, [f"{k}-{i}" for i in range(50)], f"/p/{k}", label="l" if k < 2 else ""))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(store.read("/p/1"))
    assert "PartitionFilters: [isnotnull(part" in scan
    hit = store.get_by_label("l7")
    assert hit.first().block_id == "0-7" and "part" in plan(hit).split("PartitionFilters: [")[1].split("]")[0]
    parts = store.table("labels").where((F.col("bucket") == bucket_of(F.lit("l7"))) & (F.col("label") == "l7"))
    assert "bucket" in plan(parts).split("PartitionFilters: [")[1].split("]")[0] and parts.count() == 2
    assert store.get_by_label("l7", "/p/1").first().block_id == "1-7" and store.get_by_label("l7", "/p/2").isEmpty()
    assert store.get_by_label("").first().block_id == "2-0" and store.get_by_label("none").isEmpty()
    # what the label table said once is looked up
    store.upsert(block_rows(spark, [f"0-{i}" for i in range(50)], "/p/0", label="new"))
    assert store.get_by_label("l7").first().block_id == "1-7" and store.get_by_label("new7").first().block_id == "0-7"
    store.remove_folder("/p/1")
    assert store.get_by_label("l7").isEmpty()
    assert store.table("labels").count() == 150
    store.compact()
    assert store.table("labels").count() == 50 and store.get_by_label("new7").first().block_id == "0-7" and store.get_by_label("l7").isEmpty()


def test_vectors_are_kept(spark, folder, tmp_path):
    """Texts that didn't change aren't embedded again; another model embeds all."""
    seen = tmp_path / "seen"
    seen.write_text("")

    class Counting:
        """A model that writes down how many texts it sees."""

        def __repr__(self):
            return "Counting()"

        def __call__(self):
            def encode(texts):
                with open(seen, "a") as f:
                    f.write("x" * len(texts))
                return np.ones((len(texts), 4))

            return encode

    e = Engine(spark, str(tmp_path / "db"), Embedder(Counting(), HashingModel(8)))
    e.index_folder(str(folder))
    first = len(seen.read_text())
    assert first == 4
    e.index_folder(str(folder))
    assert len(seen.read_text()) == first
    (folder / "z.tex").write_text("\\begin{lemma}\\label{l:z}changed\\end{lemma}\\begin{claim}two\\end{claim}\\begin{claim}two\\end{claim}")
    assert e.index_folder(str(folder)) == (4, 6) and len(seen.read_text()) == first + 2
    other = Engine(spark, str(tmp_path / "db"), Embedder(HashingModel(4), HashingModel(8)))
    other.index_folder(str(folder))
    assert {len(set(r.text_vec)) for r in other.store.read().collect()} != {1}


def test_scanner_takes_time_in_proportion():
    """Unclosed brackets, unmatched ends, bars without a partner: four times the source, about four times the time."""
    for piece in (lambda n: "\\section[x " * n, lambda n: "\\begin{a}" * n + "\\end{b}" * n, lambda n: "\\begin{thm}\\label{x" * n, lambda n: "\\verb|" * n + "\\verb+", lambda n: "{$" * n):
        took = []
        for n in (8000, 32_000):
            began = time.perf_counter()
            assert all(e[1] in ("section", "block") for e in latex.events(piece(n)))
            took.append(time.perf_counter() - began)
        assert took[1] < 0.2 + 8 * took[0]


def test_numbers_across_files(spark):
    """Running numbers from counts of files, in several runs of files."""
    old, plans.FILES = plans.FILES, 3
    try:
        rows = [(f, e, o, p) for f in "ab" for e in "xy" for o in range(0, 20, 2) for p in range((o * 7 + len(e)) % 4)]
        df = plans.running_number(spark.createDataFrame(rows, "folder string, env_type string, file_ord long, pos int"), ["folder", "env_type"], ["pos"])
        got = {(r.folder, r.env_type, r.file_ord, r.pos): r.n for r in df.collect()}
    finally:
        plans.FILES = old
    want, count = {}, {}
    for f, e, o, p in sorted(rows):
        count[f, e] = count.get((f, e), 0) + 1
        want[f, e, o, p] = count[f, e]
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(folder" in plan and all("file_ord" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in plan.split("\n") if "row_number()" in x and "windowspecdefinition" in x)


def test_small_functions(spark):
    one = spark.createDataFrame([("thm", "{Foo {bar}}", "/a/b.tex")], "e string, t string, p string")
    r = one.select(B.canonical(F.col("e")), B.basename(F.col("p"))).first()
    assert tuple(r) == ("theorem", "b.tex")
    assert B.where(None, "") is None
    assert render.search([{"env_type": "lemma", "score": 0.1235, "matched_view": "both", "source_file": "f", "section": "S", "label": "L", "text": " t "}]) == (
        "[1] LEMMA  (score: 0.123, view: both)\n  file: f\n  section: S\n  label:   L\n  ---\nt"
    )


def test_watch(spark, folder, tmp_path):
    from lemmata.streaming.reindex import watch

    e = Engine(spark, str(tmp_path / "db"), SMALL)
    watch(e, str(tmp_path), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert e.list_folders().first().block_count == 4


def test_watch_of_odd_roots(spark, tmp_path):
    """Signs of patterns in the root's name, and files directly below it."""
    from lemmata.streaming.reindex import watch

    root = tmp_path / "a+b (c)[d]"
    (root / "p").mkdir(parents=True)
    (root / "p" / "x.tex").write_text("\\begin{lemma}x\\end{lemma}")
    (root / "y.tex").write_text("\\begin{claim}y\\end{claim}")
    e = Engine(spark, str(tmp_path / "db"), SMALL)
    watch(e, str(root), str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = {r.block_id for r in e.store.read().collect()}
    assert got == {"x.tex::lemma::1", "y.tex::claim::1"}
