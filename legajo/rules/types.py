"""Keyword vocabulary of the document types, in declared (tie-breaking) order."""

# Label given when no method recognises a document.
UNKNOWN = "desconocido"

# Document types and the substrings that point to them.
TYPE_KEYWORDS = {
    "facturas": ["factura", "invoice", "fact", "fac", "bill"],
    "remitos": ["remito", "delivery note", "rem", "guía", "guia"],
    "notas_credito": ["nota de crédito", "nota de credito", "credit note"],
    "notas_debito": ["nota de débito", "nota de debito", "debit note"],
    "cartas_porte": ["carta de porte", "waybill", "cp", "porte", "transporte", "flete"],
    "liquidaciones_granos": [
        "liquidación primaria", "liquidación de granos", "liquidacion", "granos", "cereales", "soja",
        "trigo", "maíz", "maiz", "girasol", "sorgo", "settlement", "grain settlement",
    ],
    "cot": [
        "cot", "certificado de transferencia", "certificado", "transferencia",
        "certificate of transfer", "transferencia de granos", "transfer certificate",
    ],
    "ctg": [
        "ctg", "carta de crédito", "carta de credito", "certificado de depósito",
        "certificado de deposito", "warrant", "storage certificate",
    ],
    "pesajes": [
        "pesaje", "peso", "báscula", "bascula", "balanza", "weigh", "weight", "scale", "kg", "toneladas",
    ],
    "contratos_granos": ["contrato", "contract", "convenio", "acuerdo", "compraventa", "granos", "cereales"],
    "transferencias": [
        "transferencia bancaria", "transferencia", "transfer", "wire transfer", "giro",
        "envío de dinero", "remesa",
    ],
    "ordenes_pago": [
        "orden de pago", "payment order", "op", "orden pago", "autorización de pago",
        "payment authorization",
    ],
    "recibos": ["recibo", "receipt", "rec", "comprobante"],
    "ordenes_compra": ["orden de compra", "purchase order", "oc"],
    "contratos": ["contrato", "contract", "convenio", "acuerdo"],
}

# Points of the keyword method.
POINTS_PER_OCCURRENCE = 0.1
POINTS_IN_OPENING = 0.3
OPENING_WORDS = 100
KEYWORD_THRESHOLD = 0.7

# Terms profiled when a keyword result looks wrong.
PROFILE_TERMS = [
    "débito", "debito", "crédito", "credito", "nota",
    "liquidación", "liquidacion", "granos", "trigo", "cereales",
]

# First-match table of the earlier classifier.
FIRST_MATCH_TERMS = [
    ("facturas", ["factura"]),
    ("remitos", ["remito"]),
    ("notas_credito", ["nota de crédito", "nota de credito"]),
    ("notas_debito", ["nota de débito", "nota de debito"]),
    ("cartas_porte", ["carta de porte"]),
]
