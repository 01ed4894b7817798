"""Block, derivation and whole-build queries."""

from __future__ import annotations

from creditlake.functions.expr import settle_all
from creditlake.functions.ordering import scratch_path
from creditlake.operators import blocks as B
from creditlake.operators import derive as D
from creditlake.plans.catalogue import block_sql as S
from creditlake.plans.catalogue.registry import query
from creditlake.plans.catalogue.sqltext import settled_columns, statement
from creditlake.plans.client_features import bucketed_client_blocks, client_blocks, client_features, save_bucketed
from creditlake.sources import analog as A

KEY = ["SK_ID_CURR"]
BASE_NUMERIC = [
    "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_DOCUMENT_3", "FLAG_EMAIL",
]


def _sql(cols: list[str], source: str, ctes, keys: str = "SK_ID_CURR") -> str:
    return statement(f"SELECT {keys}, {settled_columns(cols)} FROM {source}", *ctes)


def _upto(*names: str):
    return [c for c in S.BLOCK_CTES if c[0] in names]


@query("blk_bureau_balance", _sql(S.COLS["e1"], "e1", _upto("e1"), "SK_ID_BUREAU"))
def _bureau_balance(spark, folder):
    out = B.bureau_balance_block(A.bureau(spark, folder), A.bureau_balance(spark, folder))
    return settle_all(out.select("SK_ID_BUREAU", *S.COLS["e1"]), ["SK_ID_BUREAU"])


@query("blk_bureau", _sql(S.COLS["e2"], "e2", _upto("e1", "e2")))
def _bureau(spark, folder):
    return settle_all(B.bureau_block(A.bureau(spark, folder), A.bureau_balance(spark, folder)), KEY)


@query("blk_credit_card", _sql(S.COLS["e3"], "e3", _upto("e3")))
def _credit_card(spark, folder):
    return settle_all(B.credit_card_block(A.credit_card(spark, folder)), KEY)


@query("blk_installments", _sql(S.COLS["e4"], "e4", _upto("e4")))
def _installments(spark, folder):
    return settle_all(B.installments_block(A.installments(spark, folder)), KEY)


@query("blk_pos_cash", _sql(S.COLS["e5"], "e5", _upto("e5")))
def _pos_cash(spark, folder):
    return settle_all(B.pos_cash_block(A.pos_cash(spark, folder)), KEY)


@query("blk_previous", _sql(S.COLS["e6"], "e6", _upto("e6")))
def _previous(spark, folder):
    return settle_all(B.previous_block(A.previous(spark, folder)), KEY)


@query("join_client_chain", _sql([c for b in S.BLOCKS for c in S.COLS[b]], "base", S.BLOCK_CTES))
def _chain(spark, folder):
    out = client_blocks(A.credit_tables(spark, folder))
    return settle_all(out.select(*KEY, *[c for b in S.BLOCKS for c in S.COLS[b]]), KEY)


@query("join_client_bucketed", _sql([c for b in S.BLOCKS for c in S.COLS[b]], "base", S.BLOCK_CTES))
def _bucketed(spark, folder):
    path = scratch_path(spark, "bucketed")
    prefix = "bucketed_" + path.rsplit("-", 1)[-1] + "_"
    save_bucketed(A.credit_tables(spark, folder), prefix, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = bucketed_client_blocks(spark, prefix)
    return settle_all(out.select(*KEY, *[c for b in S.BLOCKS for c in S.COLS[b]]), KEY)


_DEFAULTS_BODY = (
    "SELECT a.SK_ID_CURR, "
    + settled_columns(S.COLS["e2"])
    + " FROM (SELECT a.SK_ID_CURR AS SK_ID_CURR, "
    + S.filled("e2")
    + " FROM v_application a LEFT JOIN e2 ON a.SK_ID_CURR = e2.SK_ID_CURR) a"
)


@query("join_defaults", statement(_DEFAULTS_BODY, *_upto("e1", "e2")))
def _defaults(spark, folder):
    block = B.bureau_block(A.bureau(spark, folder), A.bureau_balance(spark, folder))
    return settle_all(B.attach(A.application(spark, folder).select(*KEY), block, B.BUREAU_DEFAULTS), KEY)


def _family(key: str, upto: int):
    cols = [n for layer in S.FAMILIES[key] for n in layer]

    @query(key, _sql(cols, S.LAST_LAYER, [*S.BLOCK_CTES, *S.derived_ctes()]))
    def run(spark, folder):
        out = client_blocks(A.credit_tables(spark, folder))
        for step in (
            D.derive_basic, D.derive_cross, D.derive_ext, D.derive_age_employment, D.derive_ratios,
            D.derive_interactions, D.derive_risk, D.derive_final,
        )[: upto + 1]:
            out = step(out)
        return settle_all(out.select(*KEY, *cols), KEY)


for _i, _key in enumerate(S.FAMILIES):
    _family(_key, _i)

_ALL = [*BASE_NUMERIC, *[c for b in S.BLOCKS for c in S.COLS[b]], *S.DERIVED]
_STRINGS = "SK_ID_CURR, CODE_GENDER, OCCUPATION_TYPE, NAME_CONTRACT_TYPE"


@query("pipe_client_features", _sql(_ALL, S.LAST_LAYER, [*S.BLOCK_CTES, *S.derived_ctes()], _STRINGS))
def _whole(spark, folder):
    return settle_all(client_features(A.credit_tables(spark, folder)), KEY)
