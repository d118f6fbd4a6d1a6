import pytest

from locusgrid.plans import catalog
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        check(df, catalog.ORACLE[name], SF)
    else:
        assert df.count() > 0
