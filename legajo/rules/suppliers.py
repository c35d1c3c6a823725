"""Built-in supplier registry, used when no registry file is given."""

# The five known suppliers. Each document pattern is
# (type, specific terms, layout indicators, confidence boost).
SUPPLIERS = [
    {
        "supplier_id": "telecom_argentina",
        "names": ["TELECOM ARGENTINA", "TELECOM", "PERSONAL"],
        "cuit": "30-50000109-4",
        "patterns": [
            ("facturas", ["SERVICIOS DE TELECOMUNICACIONES", "PLAN PERSONAL"],
             ["CONSUMO DEL PERÍODO", "PRÓXIMO VENCIMIENTO"], 0.3),
        ],
        "contact": {"website": "www.telecom.com.ar", "phone": "0800-555-0000"},
    },
    {
        "supplier_id": "edesur",
        "names": ["EDESUR S.A.", "EMPRESA DISTRIBUIDORA SUR"],
        "cuit": "30-65511620-2",
        "patterns": [
            ("facturas", ["DISTRIBUCIÓN ELÉCTRICA", "ENERGÍA CONSUMIDA", "CARGO FIJO"],
             ["KWH CONSUMIDOS", "PRÓXIMO VENCIMIENTO"], 0.3),
        ],
        "contact": {},
    },
    {
        "supplier_id": "metrogas",
        "names": ["METROGAS S.A.", "DISTRIBUIDORA DE GAS"],
        "cuit": "30-61469304-9",
        "patterns": [
            ("facturas", ["DISTRIBUCIÓN DE GAS", "M3 CONSUMIDOS", "GAS NATURAL"],
             ["MEDICIÓN ANTERIOR", "MEDICIÓN ACTUAL"], 0.3),
        ],
        "contact": {},
    },
    {
        "supplier_id": "mercadolibre",
        "names": ["MERCADOLIBRE S.R.L.", "MELI", "MERCADO LIBRE"],
        "cuit": "30-70308853-4",
        "patterns": [
            ("facturas", ["COMISIÓN POR VENTA", "MARKETPLACE", "PUBLICACIÓN"],
             ["DETALLE DE VENTAS", "COMISIONES"], 0.2),
            ("recibos", ["COBRO AUTOMÁTICO", "DÉBITO AUTOMÁTICO"], ["MEDIO DE PAGO"], 0.2),
        ],
        "contact": {},
    },
    {
        "supplier_id": "andreani",
        "names": ["ANDREANI LOGÍSTICA S.A.", "ANDREANI", "GRUPO ANDREANI"],
        "cuit": "30-50010085-2",
        "patterns": [
            ("cartas_porte", ["TRANSPORTE DE CORRESPONDENCIA", "COURIER", "ENVÍO"],
             ["DESTINATARIO", "REMITENTE", "CÓDIGO DE SEGUIMIENTO"], 0.4),
            ("remitos", ["ENTREGA A DOMICILIO", "SERVICIO PUERTA A PUERTA"],
             ["TRACKING", "CÓDIGO POSTAL"], 0.3),
        ],
        "contact": {},
    },
]

# Points of the supplier score.
POINTS_NAME = 0.4
POINTS_PARTIAL_NAME = 0.3
PARTIAL_NAME_LENGTH = 10
POINTS_TAX_ID = 0.3
POINTS_TERMS = 0.2
POINTS_INDICATORS = 0.1
SUPPLIER_THRESHOLD = 0.3
NEW_PATTERN_BOOST = 0.1
