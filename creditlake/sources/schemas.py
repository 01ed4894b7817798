"""Declared schemas of the credit tables; columns a file has beyond these pass through the parquet readers."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed names of the input columns, by type: l = long, i = int, d = double, s = string.
_COLUMNS = {
    "application": "SK_ID_CURR:l TARGET:i NAME_CONTRACT_TYPE:s CODE_GENDER:s OCCUPATION_TYPE:s AMT_INCOME_TOTAL:d "
    "AMT_CREDIT:d AMT_ANNUITY:d AMT_GOODS_PRICE:d EXT_SOURCE_1:d EXT_SOURCE_2:d EXT_SOURCE_3:d DAYS_BIRTH:i "
    "DAYS_EMPLOYED:i",
    "bureau": "SK_ID_BUREAU:l SK_ID_CURR:l CREDIT_ACTIVE:s CREDIT_TYPE:s DAYS_CREDIT:l CREDIT_DAY_OVERDUE:i "
    "CNT_CREDIT_PROLONG:i AMT_CREDIT_SUM:d AMT_CREDIT_SUM_DEBT:d AMT_CREDIT_SUM_OVERDUE:d",
    "bureau_balance": "SK_ID_BUREAU:l MONTHS_BALANCE:i STATUS:s",
    "previous_application": "SK_ID_PREV:l SK_ID_CURR:l NAME_CONTRACT_STATUS:s NAME_CONTRACT_TYPE:s NAME_YIELD_GROUP:s "
    "NAME_GOODS_CATEGORY:s DAYS_DECISION:l AMT_APPLICATION:d AMT_CREDIT:d AMT_GOODS_PRICE:d AMT_DOWN_PAYMENT:d",
    "installments_payments": "SK_ID_PREV:l SK_ID_CURR:l NUM_INSTALMENT_NUMBER:i DAYS_INSTALMENT:l "
    "DAYS_ENTRY_PAYMENT:l AMT_INSTALMENT:d AMT_PAYMENT:d",
    "pos_cash_balance": "SK_ID_PREV:l SK_ID_CURR:l MONTHS_BALANCE:i SK_DPD:i SK_DPD_DEF:i NAME_CONTRACT_STATUS:s",
    "credit_card_balance": "SK_ID_PREV:l SK_ID_CURR:l MONTHS_BALANCE:i AMT_BALANCE:d AMT_CREDIT_LIMIT_ACTUAL:d "
    "AMT_PAYMENT_CURRENT:d AMT_INST_MIN_REGULARITY:d AMT_DRAWINGS_ATM_CURRENT:d AMT_DRAWINGS_CURRENT:d "
    "CNT_DRAWINGS_CURRENT:i SK_DPD:i AMT_RECEIVABLE_PRINCIPAL:d",
    "score_request": "request_id:l sk_id_curr:l amt_credit:d annuity:d credit_type:s goods_price:d",
    "registration": "registration_id:l full_name:s dni:s email:s phone:s",
    "predictions": "row_id:l y:i score:d",
}

_TYPES = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType()}


def schema_of(table: str) -> T.StructType:
    return T.StructType(
        [T.StructField(n, _TYPES[t]) for n, t in (item.split(":") for item in _COLUMNS[table].split())]
    )


SCHEMAS = {name: schema_of(name) for name in _COLUMNS}
