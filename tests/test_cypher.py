import pytest

from skein.plans.cypher import CypherError, cypher
from skein.plans.graph import PropertyGraph, Snapshots


@pytest.fixture(scope="module")
def g(spark):
    """Authors, books and genres: who wrote, cites, reads and teaches what."""
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    authors = [(10, "Ngozi", 1931, "Enugu"), (11, "Yun", 1950, "Busan"), (12, "Olga", 1962, "Sulechow"), (13, "Italo", 1923, "Cuba"), (14, "Maryse", 1937, None), (15, "Pak", 1926, "Busan")]
    return PropertyGraph(spark, {
        "Author": spark.createDataFrame(authors, "id long, name string, born long, town string"),
        "Book": spark.createDataFrame([(20, "Flights", 2007), (21, "Cities", 1972), (22, "Land", 1969), (23, "Segu", 1984)], "id long, title string, year long"),
        "Genre": spark.createDataFrame([(30, "essay"), (31, "saga"), (32, "verse")], "id long, name string"),
        "wrote": e([(12, 20), (13, 21), (15, 22), (14, 23), (11, 22)]), "cites": e([(20, 21), (23, 21), (23, 22), (20, 23)]),
        "reads": e([(10, 31), (11, 31), (11, 30), (12, 30), (13, 30), (13, 30)]), "teaches": e([(10, 14), (14, 12), (12, 13), (15, 11), (11, 15)]),
    })


@pytest.mark.parametrize("text, want", [
    # a chain of two types
    ("MATCH (a:Author)-[:wrote]->(b:Book)-[:cites]->(c:Book) RETURN a.name AS author, count(*) AS cited ORDER BY cited DESC, author", [("Maryse", 2), ("Olga", 2)]),
    # multiplicity: a repeated relationship counts twice
    ("MATCH (g:Genre)<-[:reads]-(a:Author) RETURN g.name AS genre, count(*) AS n, count(DISTINCT a.name) AS readers ORDER BY genre", [("essay", 4, 3), ("saga", 2, 2)]),
    # a filter on an aggregate
    ("MATCH (b:Book)<-[:cites]-(:Book) WITH b, count(*) AS times WHERE times > 1 RETURN b.title AS title, times", [("Cities", 2)]),
    # variable length, with a cycle, relationships distinct along the path
    ("MATCH (a:Author {name: 'Pak'})-[:teaches*1..4]->(b:Author) RETURN b.name AS name, count(*) AS ways ORDER BY name", [("Pak", 1), ("Yun", 1)]),
    ("MATCH (a:Author {name: 'Ngozi'})-[:teaches*2..3]->(b:Author) RETURN DISTINCT b.name AS name ORDER BY name", [("Italo",), ("Olga",)]),
    # negation over a pattern, null properties
    ("MATCH (a:Author) WHERE NOT EXISTS { MATCH (a)-[:wrote]->(:Book) } RETURN a.name AS name", [("Ngozi",)]),
    ("MATCH (a:Author) WHERE a.town = 'Busan' AND NOT a.born < 1930 RETURN a.name AS name", [("Yun",)]),
    ("MATCH (b:Book) RETURN CASE WHEN b.year < 1970 THEN 'early' WHEN b.year < 1980 THEN 'middle' ELSE 'late' END AS age, count(*) AS n ORDER BY age", [("early", 1), ("late", 2), ("middle", 1)]),
    ("MATCH (a:Author) RETURN a.born AS born ORDER BY born DESC LIMIT 2", [(1962,), (1950,)]),
])
def test_queries(g, text, want):
    assert [tuple(r) for r in cypher(g, text).collect()] == want


def test_outside_the_subset(g):
    for text in ("RETURN 1", "MATCH (a:Author)-[:teaches]-(b:Author) RETURN a.name", "MATCH (a) RETURN a"):
        with pytest.raises(CypherError):
            cypher(g, text)


def test_snapshots(g):
    s = Snapshots()
    s.publish("first", g)
    assert s.versions() == ["first"] and s.graph("first") is g
    with pytest.raises(ValueError):
        s.publish("first", g)
