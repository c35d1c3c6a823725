"""Page-layout rules."""

# Layout expectations per type.
TYPES = {
    "facturas": {
        "titles": ["factura", "invoice", "bill"],
        "table_terms": ["código", "descripción", "cantidad", "precio"],
        "taxed": True,
        "sizes": [8, 10, 12, 14],
    },
    "remitos": {
        "titles": ["remito", "delivery", "entrega"],
        "table_terms": ["código", "artículo", "cantidad"],
        "taxed": False,
        "sizes": [8, 10, 12],
    },
    "notas_credito": {
        "titles": ["nota de crédito", "credit note"],
        "table_terms": ["concepto", "importe"],
        "taxed": True,
        "sizes": [8, 10, 12, 14],
    },
    "contratos": {
        "titles": ["contrato", "contract", "acuerdo"],
        "table_terms": [],
        "taxed": False,
        "sizes": [10, 11, 12],
    },
}

# Zone edges as shares of the page height, table and title words, tax words.
HEADER_EDGE = 0.15
FOOTER_EDGE = 0.85
TITLE_EDGE = 0.25
TABLE_WORDS = ["código", "descripción", "cantidad", "precio", "importe", "total"]
TITLE_WORDS = ["factura", "remito", "nota", "contrato", "recibo", "carta"]
TAX_WORDS = ["iva", "impuesto", "tax"]
TITLE_SIZE = 12
TITLE_LENGTH = 5
MARGIN = 0.05
MAX_SCORE = 5.0
