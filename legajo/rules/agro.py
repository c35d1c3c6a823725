"""Rules of the grain-trade (agro) domain."""

# Keywords, patterns and required elements per type.
TYPES = {
    "liquidaciones_granos": {
        "keywords": ["liquidación", "liquidacion", "granos", "cereales", "soja", "trigo", "maíz", "maiz",
                     "girasol", "sorgo"],
        "patterns": [
            r"liquidaci[óo]n\s+(?:de\s+)?(?:granos|cereales)",
            r"(?:soja|trigo|ma[íi]z|girasol|sorgo)",
            r"precio\s+(?:por\s+)?(?:kg|tonelada|tn|qq)",
            r"(?:humedad|protein[aí]|aceite).*%",
            r"descuento.*(?:humedad|merma)",
            r"peso\s+neto.*(?:kg|tn)",
        ],
        "required": ["precio", "peso", "grano"],
    },
    "cot": {
        "keywords": ["cot", "certificado de transferencia", "transferencia", "granos"],
        "patterns": [
            r"certificado\s+de\s+transferencia",
            r"c\.?o\.?t\.?",
            r"transfer[ae]ncia\s+(?:de\s+)?granos",
            r"depósito\s+(?:de\s+)?cereales",
            r"warrant",
        ],
        "required": ["certificado", "transferencia"],
    },
    "ctg": {
        "keywords": ["ctg", "carta de crédito", "certificado de depósito", "warrant"],
        "patterns": [
            r"carta\s+de\s+cr[ée]dito",
            r"certificado\s+de\s+dep[óo]sito",
            r"c\.?t\.?g\.?",
            r"warrant",
            r"almacenaje",
            r"dep[óo]sito\s+(?:de\s+)?granos",
        ],
        "required": ["certificado", "depósito"],
    },
    "cartas_porte": {
        "keywords": ["carta de porte", "porte", "transporte", "flete"],
        "patterns": [
            r"carta\s+de\s+porte",
            r"remito\s+(?:de\s+)?transporte",
            r"gu[íi]a\s+(?:de\s+)?transporte",
            r"flete",
            r"transportista",
            r"chapa\s+(?:del\s+)?cami[óo]n",
        ],
        "required": ["transporte", "destino"],
    },
    "pesajes": {
        "keywords": ["pesaje", "peso", "báscula", "balanza"],
        "patterns": [
            r"peso\s+(?:bruto|neto|tara)",
            r"b[áa]scula",
            r"balanza",
            r"pesaje",
            r"\d+\s*(?:kg|tn|toneladas?)",
            r"ticket\s+(?:de\s+)?peso",
        ],
        "required": ["peso"],
    },
    "contratos_granos": {
        "keywords": ["contrato", "compraventa", "granos", "cereales"],
        "patterns": [
            r"contrato\s+(?:de\s+)?(?:compraventa|compra|venta)",
            r"acuerdo\s+(?:de\s+)?(?:compraventa|comercializaci[óo]n)",
            r"condiciones\s+(?:de\s+)?entrega",
            r"precio\s+(?:por\s+)?(?:tonelada|kg|quintal)",
            r"calidad\s+(?:de\s+)?grano",
        ],
        "required": ["contrato", "precio", "grano"],
    },
}

# A required element is present when any of its patterns matches.
ELEMENTS = {
    "precio": [r"precio", r"\$\s*[\d,]+", r"valor", r"importe"],
    "peso": [r"peso", r"\d+\s*(?:kg|tn|toneladas)", r"balanza", r"báscula"],
    "grano": [r"soja|trigo|ma[íi]z|girasol|sorgo|cereales|granos"],
    "certificado": [r"certificado", r"cert\.", r"certificación"],
    "transferencia": [r"transferencia", r"transfer", r"cesión"],
    "depósito": [r"depósito", r"almacén", r"storage", r"acopio"],
    "transporte": [r"transporte", r"flete", r"camión", r"transportista"],
    "destino": [r"destino", r"entregar", r"delivery", r"dirección"],
    "contrato": [r"contrato", r"acuerdo", r"convenio", r"términos"],
}

# Bonus terms as (group, points per term, whole words only, terms).
BONUS = [
    ("granos", 0.05, False,
     ["soja", "trigo", "maíz", "maiz", "girasol", "sorgo", "avena", "cebada", "centeno"]),
    ("medidas", 0.03, True, ["kg", "tn", "toneladas", "quintales", "qq", "hectolitro", "hl"]),
    ("calidad", 0.04, False, ["humedad", "proteína", "aceite", "impurezas", "peso hectolitrico", "gluten"]),
    ("procesos", 0.03, False, ["cosecha", "acopio", "almacenaje", "secado", "clasificación", "limpieza"]),
    ("actores", 0.04, False, ["productor", "acopiador", "exportador", "cooperativa", "cerealera"]),
]

# Points and limits of the domain score.
POINTS_KEYWORD = 0.15
POINTS_MATCH = 0.2
POINTS_REQUIRED = 0.25
BONUS_LIMIT = 0.3

# Indicator patterns, matched on the original text.
GRAINS = BONUS[0][3]
WEIGHT = r"(\d+(?:,\d+)*(?:\.\d+)?)\s*(kg|tn|toneladas?|quintales?)"
PRICES = [r"\$\s*([\d,]+(?:\.\d+)?)", r"precio[:\s]*([\d,]+(?:\.\d+)?)"]
QUALITY = r"(humedad|proteína|aceite)[:\s]*([\d,]+(?:\.\d+)?)\s*%?"
DATE = r"(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4})"
