"""Built-in training samples and settings of the Naive Bayes method."""

# Words left out of the vocabulary.
STOP_WORDS = [
    "de", "la", "que", "el", "en", "y", "a", "un", "ser", "se", "no", "te", "lo", "le", "da", "su", "por",
    "son", "con", "para", "al", "del", "los", "una", "las", "por", "como", "más", "este", "total",
    "subtotal", "iva", "neto", "fecha", "numero", "código", "descripción", "cantidad", "precio", "importe",
]

# Vocabulary limits, smoothing, training split.
MIN_DOCUMENTS = 2
MAX_SHARE = 0.8
MAX_TERMS = 5000
ALPHA = 1.0
MIN_SAMPLES_PER_CLASS = 5
SPLIT_FROM = 20
TEST_SHARE = 0.2
SPLIT_SEED = 42

# Training samples as (label, text).
SAMPLES = [
    ("facturas", "FACTURA A N° 0001-00012345 ORIGINAL DUPLICADO CUIT: 20-12345678-9 PUNTO DE VENTA: 0001 CAE N°: 12345678901234 VENCIMIENTO DEL CAE: 31/12/2024 CÓDIGO DESCRIPCIÓN CANTIDAD PRECIO UNITARIO IMPORTE 001 PRODUCTO A 1 100.00 100.00 SUBTOTAL $ 100.00 IVA 21% $ 21.00 TOTAL $ 121.00"),
    ("facturas", "FACTURA B N° 0002-00067890 MONOTRIBUTISTA CUIT: 27-87654321-3 DETALLE CANTIDAD P.UNIT TOTAL SERVICIO DE CONSULTORIA 1 5000.00 5000.00 TOTAL $ 5000.00"),
    ("facturas", "ORIGINAL FACTURA A PUNTO DE VENTA 0005 N° 00000123 FECHA 15/09/2024 CUIT 30-12345678-9 RESPONSABLE INSCRIPTO ITEM DESCRIPCIÓN CANT P.UNIT NETO 1 MERCADERÍA VARIA 10 50.00 500.00 SUBTOTAL 500.00 IVA 21% 105.00 TOTAL 605.00"),
    ("remitos", "REMITO N° 0001-00012345 DOCUMENTO NO VÁLIDO COMO FACTURA DESTINATARIO: EMPRESA ABC SA CUIT: 30-11111111-1 CÓDIGO ARTÍCULO CANTIDAD 001 PRODUCTO A 5 002 PRODUCTO B 3 MERCADERÍA ENTREGADA SIN CARGO FISCAL"),
    ("remitos", "ORDEN DE ENTREGA N° R-12345 BULTOS: 3 PESO: 25 KG DESTINATARIO JUAN PEREZ MERCADERÍA ENTREGADA CONFORME FIRMA TRANSPORTISTA"),
    ("remitos", "REMITO INTERNO N° 0005-00000789 SIN CARGO FISCAL CÓDIGO DESCRIPCIÓN CANTIDAD ENTREGADA 100 ARTÍCULO VARIOS 15 200 MATERIAL OFICINA 8 TOTAL BULTOS: 2"),
    ("notas_credito", "NOTA DE CRÉDITO A N° 0001-00000123 CUIT: 20-12345678-9 ANULACIÓN PARCIAL FACTURA N° 0001-00012340 CONCEPTO: DEVOLUCIÓN MERCADERÍA DEFECTUOSA IMPORTE A FAVOR $ 100.00 CRÉDITO FISCAL IVA $ 21.00"),
    ("notas_credito", "NOTA DE CREDITO B N° 0002-00000456 MONOTRIBUTISTA DESCUENTO OTORGADO POR PAGO ANTICIPADO FACTURA ORIGINAL N° 0002-00067800 IMPORTE ORIGINAL $ 1000.00 DESCUENTO $ 50.00 NUEVO TOTAL $ 950.00"),
    ("notas_credito", "NC A N° 0003-00000789 DEVOLUCIÓN TOTAL FACTURA N° 0003-00001200 MOTIVO: ERROR EN FACTURACIÓN IMPORTE A FAVOR DEL CLIENTE $ 500.00"),
    ("notas_debito", "NOTA DE DÉBITO A N° 0001-00000123 CUIT: 20-12345678-9 CARGO ADICIONAL CONCEPTO: INTERESES MORATORIOS POR PAGO FUERA DE TÉRMINO FACTURA VENCIDA N° 0001-00012300 DÉBITO FISCAL $ 50.00"),
    ("notas_debito", "NOTA DE DEBITO B N° 0002-00000456 GASTOS ADMINISTRATIVOS POR GESTIÓN DE COBRANZA FACTURA ORIGINAL N° 0002-00067700 CARGO ADICIONAL $ 25.00"),
    ("notas_debito", "ND A N° 0003-00000789 AJUSTE DE PRECIO POR VARIACIÓN EN COSTOS FACTURA BASE N° 0003-00001100 DIFERENCIA A COBRAR $ 75.00"),
    ("cartas_porte", "CARTA DE PORTE N° CP-12345 TRANSPORTISTA: TRANSPORTE RÁPIDO SA CUIT: 30-22222222-2 CONDUCTOR: JOSÉ GARCÍA DNI: 12345678 PATENTE CHASIS: ABC123 ACOPLADO: DEF456 ORIGEN: BUENOS AIRES DESTINO: CÓRDOBA KM RECORRIDOS: 700"),
    ("cartas_porte", "CARTA PORTE NACIONAL N° 0001-00000123 MERCADERÍA A TRANSPORTAR: ALIMENTOS SECOS PESO BRUTO: 15000 KG TRANSPORTISTA HABILITADO CONDUCTOR AUTORIZADO RUTA: RN9"),
    ("cartas_porte", "CP N° 789654 TRANSPORTE DE CARGA GENERAL ORIGEN ROSARIO DESTINO MENDOZA CONDUCTOR LUIS MARTINEZ PATENTE HGI789 KM ESTIMADOS 580"),
    ("recibos", "RECIBO N° R-001234 RECIBÍ DE: EMPRESA XYZ SA LA SUMA DE: PESOS CINCO MIL CON 00/100 ($5.000,00) EN CONCEPTO DE: SEÑA CONTRATO DE ALQUILER OFICINA PERÍODO: OCTUBRE 2024 FIRMA Y ACLARACIÓN"),
    ("recibos", "RECIBO OFICIAL N° 000123 RECIBIMOS DE JUAN PÉREZ LA CANTIDAD DE $ 1.500,00 PESOS UN MIL QUINIENTOS CON 00/100 POR CONCEPTO DE HONORARIOS PROFESIONALES FECHA 15/09/2024"),
    ("recibos", "COMPROBANTE DE PAGO N° 456789 RECIBÍ LA SUMA DE $ 2.000 PESOS DOS MIL EN EFECTIVO CONCEPTO ANTICIPO SERVICIOS VARIOS FIRMA RESPONSABLE"),
]
