"""The dictionary of designations that is kept between runs."""

from collections import Counter

from nichemap import queries
from nichemap.functions.book import Book
from nichemap.functions.designations import Normaliser
from nichemap.operators import linkage


def test_second_run_parses_only_new_tokens(spark, tmp_path):
    book = Book(str(tmp_path), Normaliser())
    frame = lambda *tokens: spark.createDataFrame([(t,) for t in tokens], "token string")
    assert book.rows(spark).count() == 0
    assert book.learn(frame("DSM 1", "dsm-1", "DSM 1", None, "")) == 3
    assert book.learn(frame("DSM 1", "XK 22", "Ünï 7")) == 2
    assert book.learn(frame("XK 22", "DSM 1")) == 0 and book.learn(frame()) == 0
    got = {r["token"]: (r["version"], r["canonical"], r["kind"]) for r in book.rows(spark).collect()}
    assert got["DSM 1"] == (1, "DSM1", "collection") and got["dsm-1"][1] == "DSM1" and got["XK 22"] == (2, "XK22", "bare") and got["Ünï 7"][0] == 2 and len(got) == 5
    assert sorted(p.name for p in next(tmp_path.iterdir()).iterdir() if p.name.startswith("version")) == ["version=1", "version=2"]
    other = Book(str(tmp_path), Normaliser(collections=("XK",)))
    assert other.place != book.place and other.learn(frame("XK 22")) == 1 and other.rows(spark).first()["kind"] == "collection"


def test_linkage_is_the_same_with_a_book(spark, sf, tmp_path, monkeypatch):
    strains, genomes = queries.strains(spark, sf), queries.catalogue(spark, sf)
    plain = [Counter(map(str, x.collect())) for x in linkage.match(strains, genomes, Normaliser())]
    book, asked = Book(str(tmp_path), Normaliser()), []
    for _ in range(2):
        real = Normaliser.dictionary
        monkeypatch.setattr(Normaliser, "dictionary", lambda self, tokens, column="token", real=real: asked.append(tokens.count()) or real(self, tokens, column))
        assert [Counter(map(str, x.collect())) for x in linkage.match(strains, genomes, Normaliser(), book=book)] == plain
        monkeypatch.setattr(Normaliser, "dictionary", real)
    assert asked[0] > 1000 and asked[1] == 0
    spark.catalog.clearCache()
