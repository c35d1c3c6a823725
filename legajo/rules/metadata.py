"""Extraction patterns for tax ids, dates, amounts, suppliers and document numbers."""

# Metadata patterns.
TAX_ID = r"\d{2}-\d{8}-\d"
DATES = [
    r"\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4}",
    r"\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2}",
    r"\d{1,2}\s+de\s+\w+\s+de\s+\d{4}",
]
AMOUNT = r"\$\s*[\d,]+\.?\d*"
SUPPLIER_LINE = [
    r"Razón Social:?\s*([A-Z][A-Za-z\s&\.]{3,50})",
    r"Proveedor:?\s*([A-Z][A-Za-z\s&\.]{3,50})",
    r"Empresa:?\s*([A-Z][A-Za-z\s&\.]{3,50})",
    r"^([A-Z][A-Za-z\s&\.]{10,50})\s*(S\.A\.|SRL|SA|LTDA)",
]
SUPPLIER_LINES = 10
DOCUMENT_NUMBER = [
    r"N[úu]mero:?\s*(\d+[-/]?\d*)",
    r"N[°º]:?\s*(\d+[-/]?\d*)",
    r"Factura N[°º]:?\s*(\d+[-/]?\d*)",
    r"Remito N[°º]:?\s*(\d+[-/]?\d*)",
    r"Documento N[°º]:?\s*(\d+[-/]?\d*)",
]

# Spanish month names for written dates.
MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

# Supplier fields searched in free text, first pattern hit wins.
SUPPLIER_FIELDS = {
    "razón_social": [
        r"RAZÓN\s+SOCIAL\s*:?\s*([A-Z\s&\.]{5,50})",
        r"EMPRESA\s*:?\s*([A-Z\s&\.]{5,50})",
        r"PROVEEDOR\s*:?\s*([A-Z\s&\.]{5,50})",
    ],
    "nombre_comercial": [
        r"NOMBRE\s+COMERCIAL\s*:?\s*([A-Z\s&\.]{3,30})",
        r"DENOMINACIÓN\s*:?\s*([A-Z\s&\.]{3,30})",
    ],
    "cuit_empresa": [
        r"CUIT\s*:?\s*(\d{2}-\d{8}-\d)",
        r"C\.U\.I\.T\.?\s*:?\s*(\d{2}-\d{8}-\d)",
    ],
    "domicilio": [
        r"DOMICILIO\s*:?\s*([A-Za-z\s\d\.]{10,80})",
        r"DIRECCIÓN\s*:?\s*([A-Za-z\s\d\.]{10,80})",
    ],
    "teléfono": [
        r"TEL[ÉE]FONO\s*:?\s*([\d\s\-\(\)]{8,20})",
        r"TEL\s*:?\s*([\d\s\-\(\)]{8,20})",
    ],
}
