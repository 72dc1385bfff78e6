"""Small hand-made inputs for golden cases (values from the reference's sample data)."""

from pyspark.sql import functions as F

STAR_FACT = [
    # business_date, entity, product, account, currency, counterparty, cost_center, amount
    ("2026-02-23", "US_BANK", "FX_SPOT", "TRADING_PNL", "USD", "CPTY_A", "CC_100", 1500000.00),
    ("2026-02-23", "US_BANK", "FX_SPOT", "TRADING_PNL", "EUR", "CPTY_B", "CC_100", 2300000.00),
    ("2026-02-23", "US_BANK", "FX_FORWARD", "TRADING_PNL", "USD", "CPTY_A", "CC_100", 750000.00),
    ("2026-02-23", "US_BANK", "FX_FORWARD", "TRADING_PNL", "GBP", "CPTY_C", "CC_200", -320000.00),
    ("2026-02-23", "US_BANK", "IR_SWAP", "HEDGE_PNL", "USD", "CPTY_D", "CC_300", 5000000.00),
    ("2026-02-23", "EU_BANK", "FX_SPOT", "TRADING_PNL", "EUR", "CPTY_E", "CC_400", 1800000.00),
    ("2026-02-23", "EU_BANK", "EQUITY_OPT", "TRADING_PNL", "EUR", "CPTY_F", "CC_400", 920000.00),
    ("2026-02-23", "EU_BANK", "IR_SWAP", "HEDGE_PNL", "EUR", "CPTY_G", "CC_500", 3500000.00),
    ("2026-02-23", "APAC_BANK", "FX_SPOT", "TRADING_PNL", "JPY", "CPTY_H", "CC_600", 450000.00),
    ("2026-02-23", "APAC_BANK", "FX_FORWARD", "TRADING_PNL", "JPY", "CPTY_H", "CC_600", 125000.00),
    ("2026-02-24", "US_BANK", "FX_SPOT", "TRADING_PNL", "USD", "CPTY_A", "CC_100", 1520000.00),
    ("2026-02-24", "US_BANK", "FX_SPOT", "TRADING_PNL", "EUR", "CPTY_B", "CC_100", 2280000.00),
    ("2026-02-24", "US_BANK", "FX_FORWARD", "TRADING_PNL", "USD", "CPTY_A", "CC_100", 770000.00),
    ("2026-02-24", "US_BANK", "FX_FORWARD", "TRADING_PNL", "GBP", "CPTY_C", "CC_200", -280000.00),
    ("2026-02-24", "US_BANK", "IR_SWAP", "HEDGE_PNL", "USD", "CPTY_D", "CC_300", 5100000.00),
    ("2026-02-24", "EU_BANK", "FX_SPOT", "TRADING_PNL", "EUR", "CPTY_E", "CC_400", 1850000.00),
    ("2026-02-24", "EU_BANK", "EQUITY_OPT", "TRADING_PNL", "EUR", "CPTY_F", "CC_400", 950000.00),
    ("2026-02-24", "EU_BANK", "IR_SWAP", "HEDGE_PNL", "EUR", "CPTY_G", "CC_500", 3600000.00),
    ("2026-02-24", "APAC_BANK", "FX_SPOT", "TRADING_PNL", "JPY", "CPTY_H", "CC_600", 460000.00),
    ("2026-02-24", "APAC_BANK", "FX_FORWARD", "TRADING_PNL", "JPY", "CPTY_H", "CC_600", 130000.00),
]
POSITION = ("cobid", "entity_key", "product_key", "account_key", "currency_key", "counterparty_key", "cost_center_key")
FILTER_MAP = {"entity_code": "entity_key", "product_code": "product_key", "currency_code": "currency_key"}
HEADER_SCHEMA = ("restatement_id bigint, cobid int, source_cobid int, restatement_type string, "
                 "scale_factor decimal(10,4), created_date timestamp, entity_code string, product_code string, "
                 "currency_code string")


def star_fact(spark):
    df = spark.createDataFrame(STAR_FACT, "business_date string, entity_key string, product_key string, "
                               "account_key string, currency_key string, counterparty_key string, "
                               "cost_center_key string, amount double")
    return df.select(F.date_format(F.to_date("business_date"), "yyyyMMdd").cast("int").alias("cobid"),
                     *POSITION[1:], F.col("amount").cast("decimal(18,2)").alias("amount"))


def headers(spark, rows):
    from datetime import datetime
    from decimal import Decimal
    fixed = [(r[0], r[1], r[2], r[3], Decimal(str(r[4])), datetime.fromisoformat(r[5]), *r[6:]) for r in rows]
    return spark.createDataFrame(fixed, HEADER_SCHEMA)
