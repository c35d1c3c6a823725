"""Regular expressions of the pattern method and of the document-structure check."""

# Patterns per document type, case-insensitive, multi-line.
TYPE_PATTERNS = {
    "facturas": [
        r"FACTURA\s+[A-Z]?\s*N[°º]?\s*\d+",
        r"ORIGINAL\s+DUPLICADO",
        r"CÓDIGO\s+DESCRIPCIÓN\s+CANTIDAD",
        r"SUBTOTAL.*TOTAL",
        r"IVA\s+(21|10\.5|27)%",
        r"PUNTO\s+DE\s+VENTA\s*:\s*\d+",
        r"CAE\s*N[°º]?\s*:\s*\d+",
        r"VENCIMIENTO\s+DEL\s+CAE",
    ],
    "remitos": [
        r"REMITO\s*N[°º]?\s*\d+",
        r"ORDEN\s+DE\s+ENTREGA",
        r"DESTINATARIO",
        r"BULTOS\s+PESO",
        r"MERCADERÍA\s+ENTREGADA",
        r"CÓDIGO\s+ARTÍCULO\s+CANTIDAD",
        r"SIN\s+CARGO\s+FISCAL",
        r"DOCUMENTO\s+NO\s+VÁLIDO",
    ],
    "notas_credito": [
        r"NOTA\s+DE\s+CR[EÉ]DITO\s*N[°º]?\s*\d+",
        r"ANULACIÓN\s+PARCIAL",
        r"DEVOLUCIÓN",
        r"DESCUENTO\s+OTORGADO",
        r"IMPORTE\s+A\s+FAVOR",
        r"CRÉDITO\s+FISCAL",
    ],
    "notas_debito": [
        r"NOTA\s+DE\s+D[EÉ]BITO\s*N[°º]?\s*\d+",
        r"CARGO\s+ADICIONAL",
        r"INTERESES\s+MORATORIOS",
        r"GASTOS\s+ADMINISTRATIVOS",
        r"AJUSTE\s+DE\s+PRECIO",
        r"DÉBITO\s+FISCAL",
    ],
    "cartas_porte": [
        r"CARTA\s+DE\s+PORTE\s*N[°º]?\s*\d+",
        r"TRANSPORTISTA",
        r"ORIGEN.*DESTINO",
        r"CONDUCTOR.*DNI",
        r"PATENTE.*ACOPLADO",
        r"MERCADERÍA\s+A\s+TRANSPORTAR",
        r"KM\s+RECORRIDOS",
    ],
    "recibos": [
        r"RECIBO\s*N[°º]?\s*\d+",
        r"RECIBÍ\s+DE",
        r"LA\s+SUMA\s+DE",
        r"PESOS\s+CON\s+\d+/100",
        r"EN\s+CONCEPTO\s+DE",
        r"FIRMA\s+Y\s+ACLARACIÓN",
    ],
    "ordenes_compra": [
        r"ORDEN\s+DE\s+COMPRA\s*N[°º]?\s*\d+",
        r"PROVEEDOR\s*:",
        r"FECHA\s+DE\s+ENTREGA",
        r"CONDICIONES\s+DE\s+PAGO",
        r"LUGAR\s+DE\s+ENTREGA",
        r"AUTORIZADO\s+POR",
    ],
    "contratos": [
        r"CONTRATO\s+(DE\s+)?(LOCACIÓN|TRABAJO|SERVICIOS)",
        r"PARTES\s+CONTRATANTES",
        r"CLÁUSULAS\s+PARTICULARES",
        r"VIGENCIA\s+DEL\s+CONTRATO",
        r"EN\s+PRUEBA\s+DE\s+CONFORMIDAD",
        r"FIRMA.*FECHA",
    ],
}

# A pattern scores at most this many matches.
MATCHES_PER_PATTERN = 3

# Structure groups. The header group is case-sensitive and multi-line, the others
# ignore case.
HEADER_PATTERNS = [r"^[A-Z\s]{10,50}$", r"^\s*ORIGINAL\s*$", r"^\s*DUPLICADO\s*$"]
TABLE_PATTERNS = [
    r"CÓDIGO\s+DESCRIPCIÓN\s+CANTIDAD\s+PRECIO",
    r"ITEM\s+DETALLE\s+CANT\s+P\.UNIT",
    r"\|\s*\w+\s*\|\s*\w+\s*\|\s*\d+\s*\|",
]
TOTAL_PATTERNS = [
    r"SUBTOTAL\s*:?\s*\$?\s*[\d,]+\.?\d*",
    r"TOTAL\s*:?\s*\$?\s*[\d,]+\.?\d*",
    r"NETO\s*:?\s*\$?\s*[\d,]+\.?\d*",
]
TAX_PATTERNS = [
    r"CAE\s*N[°º]?\s*:\s*\d{14}",
    r"CUIT\s*:?\s*\d{2}-\d{8}-\d",
    r"VENCIMIENTO\s+DEL\s+CAE\s*:\s*\d{2}/\d{2}/\d{4}",
    r"PUNTO\s+DE\s+VENTA\s*:\s*\d{5}",
    r"RESPONSABLE\s+INSCRIPTO|MONOTRIBUTISTA|EXENTO",
]
TAX_MINIMUM = 2
