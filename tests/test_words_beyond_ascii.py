import duckdb
import pytest

from foliant.plans import catalogue

from .oracle import TABLES, assert_same

REPLIES = ["decía mucho mäs", "en mayíñ estä", "ñ2019 vale poco ahora", "é12/5 dicho aquí", "das Märs. Maß ärs fehlt", "el dré Andrés habla", "octöber percentó día", "2019ñ vale nov", "mar día", "mrñ señor Abel Cruz"]


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """The small tables with replies (of letters that the SQL knows) whose words mix letters beyond ASCII with month names, numbers and titles."""
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "conversations":
            (d / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    kinds = duckdb.sql(f"describe select conv_id, turn from '{sf_dir}/conversations.parquet'").fetchall()
    rows = ", ".join(f"({i}, 0, 'user', '¿What is the total day {i}?'), ({i}, 1, 'assistant', '{t}')" for i, t in enumerate(REPLIES * 6))
    duckdb.sql(f"copy (select conv_id::{kinds[0][1]} as conv_id, turn::{kinds[1][1]} as turn, role, text from (values {rows}) t(conv_id, turn, role, text)) to '{d}/conversations.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["q12_pred_type", "q52c_typed_shortest", "q56_route_features", "q85_grounding_variants", "q190_output_features"])
def test_words_end_at_letters_beyond_ascii(spark, odd, name):
    assert_same(catalogue.QUERIES[name](spark, odd), catalogue.ORACLES[name], odd)
