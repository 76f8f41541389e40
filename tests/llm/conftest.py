import pytest


@pytest.fixture
def books(spark):
    """Rows of the columns given, the others NULL."""
    from scriptorium.schemas import BOOKS

    def make(*rows, **extra):
        names = [f.name for f in BOOKS.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], BOOKS)

    return make


@pytest.fixture
def wishes(spark):
    from scriptorium.schemas import WISHLIST

    def make(*rows):
        names = [f.name for f in WISHLIST.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], WISHLIST)

    return make
