"""Tables in and out, and the entity view over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The view has misspelt, decorated and moved copies of part names as companies, and addresses in five parts.
ENTITY_SQL = """
select c_custkey as rec_id,
 concat(case when c_custkey%13=3 then replace(p_name,' ','  ') when c_custkey%13=5 then concat('(old) ',p_name) when c_custkey%13=7 then concat(p_name,'s') else p_name end,
   ' ',p_type, case c_custkey%5 when 0 then ' LLC' when 1 then ' Inc.' when 2 then ' & Co' when 3 then ' Svcs' else '' end) as company_name,
 case when c_custkey%7=0 then '' else cast(100+(p_partkey%40)*10+case when c_custkey%17=0 then 500 else 0 end as varchar(10)) end as addr_street_number,
 case when c_custkey%7=0 then '' else concat(lower(replace(p_brand,'#',' ')),' street') end as addr_street_name,
 lower(n_name) as addr_city,
 case (n_regionkey+case when c_custkey%11=0 then 1 else 0 end)%5 when 0 then 'IL' when 1 then 'WI' when 2 then 'IN' when 3 then 'IA' else 'MO' end as addr_state,
 lpad(cast(60000+n_nationkey as varchar(10)),5,'0') as addr_zip
 from {customer} join {part} on p_partkey=c_custkey%200 join {nation} on n_nationkey=p_size%25
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "part", "nation")}
    return spark.sql(ENTITY_SQL, **tables)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A DataFrame from pandas or Python rows."""
    return spark.createDataFrame(rows, schema)
