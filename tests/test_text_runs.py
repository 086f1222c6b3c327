"""Folds to runs of a text's glyphs, against the folds over glyphs."""

import itertools
import random
import sys
from collections import Counter, namedtuple

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions.dialect import SPARK
from quire.operators import sequential
from quire.operators.catalog import over_files
from quire.operators.sequential import FOLDS, SPACES
from quire.sources.derived import with_clause

ROWS = {
    "xo04_char_classes": ("doc_id page seq source", lambda r, x: ("".join(r.choice("aa b1²½+_.,(){^𝟙é" + r.choice(["", "", "", "•"])) for _ in range(r.randrange(1, 30))),)),
    "wf04_char_paragraphs": ("doc_id page seq label xobj n ink", lambda r, x: (r.choice("tuv"), r.randrange(2), n := r.randrange(1, 9), r.choice([0, 0, min(2, n), n]))),
    "wf10_line_clusters": ("doc_id page seq x y2 n", lambda r, x: (x, r.randrange(-300, 300), r.choice([1, 39, 40, 41, r.randrange(1, 700)]))),
}
DOCUMENTS = [
    (1, "\n".join(["x" * 700, "a b", "  (3.5) ²½., x", "\t 　", "y" * 41, "", "c" * 1500, "d" * 40, "•1 2", "1.2²•3", "z" * 90] * 3)),
    (-7, "one\n \n" + "é𝒳" * 300 + "\n12²\n  two"),
    (10, "1²\n\n"),
    (11, ""),
    (12, None),
    (None, "lost"),
    (13, "ab²½.\n c\n" + "e" * 500),
    (13, "ab²½.\n c\n" + "e" * 500),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ROWS)
@pytest.mark.parametrize("seed", range(12))
def test_table_against_step(name, seed):
    """Pages of a few columns, at times too near each other for the short way, and texts of one place."""
    r, (columns, make) = random.Random(seed), ROWS[name]
    row, fold = namedtuple("Row", columns), FOLDS[name].runs
    groups = []
    for page in range(r.randrange(1, 6)):
        places = r.choice([(50, 310), (50, 310), (50, 310), (50, 52), (50, 280), (7,)])
        groups.append([row(1, page, k // r.choice([1, 1, 2]), *make(r, r.choice(places))) for k in range(r.randrange(1, 12))])
        kind = {x.seq: x for x in groups[-1]}
        groups[-1] = [x._replace(**{c: getattr(kind[x.seq], c) for c in ("label", "xobj") if c in x._fields}) for x in sorted(groups[-1], key=lambda x: x.seq)]
    if "page" not in fold.keys:
        groups = [list(g) for rows in groups for _, g in itertools.groupby(rows, key=lambda x: x.seq)]
        groups = [[x._replace(doc_id=k) for x in g] for k, g in enumerate(groups)]
    sizes = [len(g) for g in groups]
    got = fold.table(pd.DataFrame([x for g in groups for x in g]), np.repeat(np.arange(len(sizes)), sizes), np.cumsum([0, *sizes[:-1]]))
    glyphs = lambda rows: Counter((*t[:-3], i, t[-1]) for t in rows for i in range(t[-3], t[-2] + 1))
    assert glyphs(got[fold.columns].itertuples(index=False, name=None)) == glyphs(t for g in groups for t in fold.step(g))


@pytest.mark.parametrize("name", ROWS)
@pytest.mark.parametrize("folder", [None, "/root/testdata/sf0.001"])
def test_runs_against_the_fold_over_glyphs(spark, sf, name, folder):
    fold, folder = FOLDS[name], folder or sf
    want = fold.on(over_files(spark, with_clause(SPARK, fold.source), folder))
    got = fold.query(spark, folder)
    assert got.dtypes == want.dtypes
    if folder == sf:
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) != Counter()
    total = lambda frame: frame.select(F.xxhash64(*frame.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    assert total(got) == total(want)


@pytest.mark.parametrize("name", ROWS)
def test_glyphs_are_made_last(spark, name):
    """Python gets texts and gives runs; no glyph is sorted or sent to it."""
    plan = FOLDS[name].query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(") < plan.index("MapInPandas")
    assert "split(source" not in plan


def test_spaces_are_those_of_python():
    assert SPACES == "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@pytest.mark.parametrize("most", [1, 7, 40])
def test_classes_of_texts_in_pieces(monkeypatch, most):
    """Texts longer than a piece, chains of marks across texts and an empty sign, which the rule takes for a bullet."""
    monkeypatch.setattr(sequential, "TOGETHER", most)
    texts = ["1" + "." * 50, "...", "²1²²,(", "•1", "x" * 45, "1", ".²"]
    rows, n = pd.DataFrame({"doc_id": 1, "seq": range(len(texts)), "source": texts}), np.arange(len(texts))
    got = FOLDS["xo04_char_classes"].runs.table(rows, n, n)
    assert [t for r in got.itertuples() for t in [r.tag] * (r.hi - r.lo + 1)] == [t[-1] for r in rows.itertuples() for t in sequential.text_classes([r])]
    glyphs = pd.DataFrame({"doc_id": 1, "seq": 1, "i": range(4), "ch": ["1", "", "1", "."]})
    assert sequential.char_classes_whole(glyphs, np.zeros(4, int), np.zeros(1, int)).tolist() == [t[-1] for t in sequential.char_classes(list(glyphs.itertuples()))]
