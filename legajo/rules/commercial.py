"""Rules of the commercial and financial domain."""

# Keywords, patterns and required elements per type.
TYPES = {
    "transferencias": {
        "keywords": ["transferencia bancaria", "transferencia", "transfer", "wire transfer", "giro",
                     "envío de dinero", "remesa"],
        "patterns": [
            r"transferencia\s+(?:bancaria|electr[óo]nica)",
            r"wire\s+transfer",
            r"swift\s+(?:code|mt)",
            r"n[úu]mero\s+de\s+(?:transferencia|operaci[óo]n)",
            r"c[óo]digo\s+de\s+transferencia",
            r"banco\s+(?:origen|destino)",
            r"cbu\s+(?:origen|destino)",
            r"alias\s+(?:cbu|bancario)",
        ],
        "required": ["transferencia", "banco", "importe"],
    },
    "ordenes_pago": {
        "keywords": ["orden de pago", "payment order", "op", "orden pago", "autorización de pago",
                     "payment authorization"],
        "patterns": [
            r"orden\s+de\s+pago",
            r"payment\s+order",
            r"autorizaci[óo]n\s+(?:de\s+)?pago",
            r"solicitud\s+(?:de\s+)?pago",
            r"n[úu]mero\s+(?:de\s+)?(?:orden|op)",
            r"beneficiario",
            r"concepto\s+(?:del\s+)?pago",
            r"fecha\s+(?:de\s+)?vencimiento",
        ],
        "required": ["orden", "pago", "beneficiario"],
    },
    "cheques": {
        "keywords": ["cheque", "check", "ch", "orden de pago al portador"],
        "patterns": [
            r"cheque\s+(?:n[úu]mero|nro|no|#)",
            r"p[áa]guese\s+(?:a|al)",
            r"banco\s+(?:emisor|girado)",
            r"fecha\s+(?:de\s+)?emisi[óo]n",
            r"importe\s+en\s+(?:letras|palabras)",
            r"cuenta\s+corriente",
            r"cuit\s+(?:del\s+)?(?:emisor|girador)",
        ],
        "required": ["cheque", "banco", "importe"],
    },
    "recibos_pago": {
        "keywords": ["recibo de pago", "recibo", "receipt", "comprobante de pago"],
        "patterns": [
            r"recibo\s+(?:de\s+)?pago",
            r"comprobante\s+(?:de\s+)?pago",
            r"recib[íi]\s+(?:de|del)",
            r"cancelaci[óo]n\s+(?:de|del)",
            r"pago\s+(?:de|por)",
            r"concepto\s+(?:del\s+)?pago",
            r"forma\s+(?:de\s+)?pago",
            r"m[ée]todo\s+(?:de\s+)?pago",
        ],
        "required": ["recibo", "pago"],
    },
    "estados_cuenta": {
        "keywords": ["estado de cuenta", "extracto", "resumen de cuenta", "statement"],
        "patterns": [
            r"estado\s+(?:de\s+)?cuenta",
            r"extracto\s+(?:bancario|de\s+cuenta)",
            r"resumen\s+(?:de\s+)?cuenta",
            r"account\s+statement",
            r"saldo\s+(?:anterior|actual|final)",
            r"movimientos\s+(?:del\s+)?per[íi]odo",
            r"fecha\s+(?:de\s+)?(?:inicio|fin)",
            r"n[úu]mero\s+(?:de\s+)?cuenta",
        ],
        "required": ["cuenta", "saldo"],
    },
    "notas_credito": {
        "keywords": ["nota de crédito", "nota de credito", "credit note", "nc", "devolución", "reintegro"],
        "patterns": [
            r"nota\s+(?:de\s+)?cr[ée]dito",
            r"credit\s+note",
            r"devoluci[óo]n\s+(?:de\s+)?(?:dinero|importe|pago)",
            r"reintegro\s+(?:de|por)",
            r"anulaci[óo]n\s+(?:de\s+)?(?:factura|cobro)",
            r"ajuste\s+(?:a\s+)?favor",
            r"bonificaci[óo]n\s+(?:por|de)",
            r"descuento\s+(?:posterior|aplicado)",
            r"cr[ée]dito\s+(?:a\s+)?favor",
            r"reversi[óo]n\s+(?:de\s+)?cargo",
        ],
        "required": ["nota", "credito", "importe"],
    },
    "notas_debito": {
        "keywords": ["nota de débito", "nota de debito", "debit note", "nd", "cargo adicional", "ajuste"],
        "patterns": [
            r"nota\s+(?:de\s+)?d[ée]bito",
            r"debit\s+note",
            r"cargo\s+(?:adicional|extra|posterior)",
            r"ajuste\s+(?:en\s+contra|negativo)",
            r"recargo\s+(?:por|de)",
            r"inter[ée]s\s+(?:por\s+)?mora",
            r"penalizaci[óo]n\s+(?:por|de)",
            r"comisi[óo]n\s+(?:bancaria|por)",
            r"gasto\s+(?:administrativo|bancario)",
            r"d[ée]bito\s+(?:en\s+)?cuenta",
        ],
        "required": ["nota", "debito", "importe"],
    },
}

# A required element is present when any of its patterns matches.
ELEMENTS = {
    "transferencia": [r"transferencia", r"transfer", r"giro", r"envío"],
    "banco": [r"banco", r"bank", r"entidad\s+financiera", r"cbu", r"swift"],
    "importe": [r"importe", r"monto", r"cantidad", r"\$\s*[\d,]+", r"amount"],
    "orden": [r"orden", r"order", r"solicitud", r"autorizaci[óo]n"],
    "pago": [r"pago", r"payment", r"abono", r"cancelaci[óo]n"],
    "beneficiario": [r"beneficiario", r"beneficiary", r"destinatario", r"p[áa]guese\s+a"],
    "cheque": [r"cheque", r"check", r"ch\s+n", r"n[úu]mero.*cheque"],
    "recibo": [r"recibo", r"receipt", r"comprobante", r"recib[íi]"],
    "cuenta": [r"cuenta", r"account", r"cta", r"n[úu]mero.*cuenta"],
    "saldo": [r"saldo", r"balance", r"disponible", r"movimiento"],
    "nota": [r"nota", r"note", r"comprobante", r"documento"],
    "credito": [r"cr[ée]dito", r"credit", r"devoluci[óo]n", r"reintegro", r"bonificaci[óo]n"],
    "debito": [r"d[ée]bito", r"debit", r"cargo", r"recargo", r"ajuste"],
}

# Bonus terms as (group, points per term, whole words only, terms).
BONUS = [
    ("bancos", 0.04, False, ["banco", "bank", "financial", "financiero", "entidad", "sucursal"]),
    ("pagos", 0.05, False, ["pago", "payment", "abono", "cancelación", "liquidación", "settlement"]),
    ("monedas", 0.03, True, ["pesos", "dollars", "usd", "ars", "eur", "euros", "uyu"]),
    ("cuentas", 0.04, False, ["cuenta", "account", "cbu", "alias", "iban", "swift", "routing"]),
    ("conceptos", 0.02, False, ["concepto", "motivo", "razón", "descripción", "detalle", "observaciones"]),
    ("ajustes", 0.04, False,
     ["devolución", "reintegro", "bonificación", "descuento", "cargo", "recargo", "ajuste"]),
    ("notas", 0.03, False, ["nota", "comprobante", "documento", "emisión", "anulación", "reversión"]),
]

# Points and limits of the domain score.
POINTS_KEYWORD = 0.15
POINTS_MATCH = 0.2
POINTS_REQUIRED = 0.3
BONUS_LIMIT = 0.30

# Indicator patterns, matched on the original text.
AMOUNTS = [r"\$\s*([\d,]+(?:\.\d+)?)", r"(?:usd|ars|eur)\s*([\d,]+(?:\.\d+)?)"]
ACCOUNTS = [r"(?:cuenta|cbu|cta).*?(\d{10,})", r"alias.*?([a-zA-Z0-9.]+)"]
BANKS = [r"banco\s+([a-záéíóúñ\s]+)", r"(bbva|santander|galicia|nación|macro|icbc)"]
PAYMENT = r"(transferencia|cheque|efectivo|débito|crédito)"
DATE = r"(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4})"
