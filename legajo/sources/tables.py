"""Input tables and the document corpus derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.session import written_table

# One text per order: a heading that depends on the kind of document, supplier line, tax id, date,
# body, quantity and amount. The same statement runs in other SQL engines.
BUSINESS_DOCS_SQL = """
SELECT o.o_orderkey AS doc_id,
       concat('doc_', lpad(cast(o.o_orderkey AS string), 8, '0'), '.pdf') AS filename,
       o.o_orderdate AS processed_at,
       concat(
         CASE o.o_orderkey % 12
           WHEN 0 THEN 'FACTURA A N° '
           WHEN 1 THEN 'REMITO N° '
           WHEN 2 THEN 'NOTA DE CRÉDITO N° '
           WHEN 3 THEN 'NOTA DE DÉBITO N° '
           WHEN 4 THEN 'CARTA DE PORTE N° '
           WHEN 5 THEN 'LIQUIDACIÓN DE GRANOS SOJA N° '
           WHEN 6 THEN 'CERTIFICADO DE TRANSFERENCIA COT N° '
           WHEN 7 THEN 'TICKET DE PESAJE BÁSCULA N° '
           WHEN 8 THEN 'ORDEN DE PAGO N° '
           WHEN 9 THEN 'TRANSFERENCIA BANCARIA N° '
           WHEN 10 THEN 'RECIBO N° '
           ELSE 'Listado interno ' END,
         lpad(cast(o.o_orderkey AS string), 8, '0'), chr(10),
         'Razón Social: ', CASE WHEN o.o_custkey % 5 = 0 THEN 'EDESUR S.A.'
           WHEN o.o_custkey % 5 = 1 THEN 'TELECOM ARGENTINA' ELSE c.c_mktsegment END, chr(10),
         'CUIT: 30-', lpad(cast(o.o_custkey AS string), 8, '0'), '-', cast(o.o_custkey % 10 AS string), chr(10),
         'Fecha: ', lpad(cast(day(o.o_orderdate) AS string), 2, '0'), '/',
           lpad(cast(month(o.o_orderdate) AS string), 2, '0'), '/', cast(year(o.o_orderdate) AS string), chr(10),
         CASE o.o_orderkey % 12
           WHEN 0 THEN 'CÓDIGO DESCRIPCIÓN CANTIDAD'
           WHEN 1 THEN 'DESTINATARIO MERCADERÍA ENTREGADA SIN CARGO FISCAL'
           WHEN 2 THEN 'Devolución de importe' WHEN 3 THEN 'Interés por mora cargo adicional'
           WHEN 4 THEN 'TRANSPORTISTA flete ORIGEN Rosario DESTINO Puerto'
           WHEN 5 THEN 'Precio por tonelada Humedad: 14% Proteína: 38%'
           WHEN 6 THEN 'transferencia de granos trigo depósito de cereales'
           WHEN 7 THEN 'Peso Bruto Peso Tara Peso Neto balanza'
           WHEN 8 THEN 'Beneficiario concepto del pago' WHEN 9 THEN 'banco origen banco destino cbu origen'
           WHEN 10 THEN 'RECIBÍ DE LA SUMA DE EN CONCEPTO DE' ELSE 'sin datos' END, chr(10),
         'Cantidad: ', cast(l.qty AS string), ' kg', chr(10),
         CASE WHEN o.o_orderkey % 12 = 0 THEN 'SUBTOTAL IVA 21% ' ELSE '' END,
         'TOTAL $ ', cast(cast(round(o.o_totalprice) AS bigint) AS string), '.00') AS text
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN (SELECT l_orderkey, cast(sum(l_quantity) AS bigint) AS qty FROM {lineitem} GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
"""


#: Documents of one file. Classifying a document takes about a millisecond and reading it some microseconds; a task takes
#: whole files of up to spark.sql.files.maxPartitionBytes, each counted with spark.sql.files.openCostInBytes (4 MB) on top.
DOCS_PER_FILE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def business_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, filename, processed_at, text``, written once per input folder."""

    def build() -> DataFrame:
        names = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem")}
        docs = spark.sql(BUSINESS_DOCS_SQL, **names)
        # texts are far larger than the rows they are made of, so files are cut after they are made, by size
        return docs.withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz")).hint("rebalance")

    return written_table(spark, "business_docs", sf_dir, build, rows_per_file=DOCS_PER_FILE)
