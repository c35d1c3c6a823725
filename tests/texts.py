"""Texts for tests: short ones with a stated category, longer ones and edge cases."""

# Short texts with the category or type they stand for.
AGRO = ["liquidaciones_granos", "cartas_porte", "cot", "ctg", "pesajes", "contratos_granos"]
COMMERCIAL = ["transferencias", "ordenes_pago", "cheques", "recibos_pago", "estados_cuenta"]
EXPECTED = [
    ("LIQUIDACION DE SOJA - Lote 123 - Precio: $450/tn - Peso: 25000kg - Humedad: 14%", AGRO),
    ("CARTA DE PORTE N° 456 - Transporte de granos de soja desde campo hasta puerto", AGRO),
    ("COT Certificado de Transferencia - Granos de trigo - 30 toneladas", AGRO),
    ("ORDEN DE PAGO N° 789 - Importe: $125,000 - Concepto: Pago servicios profesionales", COMMERCIAL),
    ("TRANSFERENCIA BANCARIA - CBU: 1234567890 - Monto: $85,500 - Destino: Cuenta corriente", COMMERCIAL),
    ("CHEQUE N° 001234 - Banco Nación - Importe: $45,000 - Fecha: 15/12/2024", COMMERCIAL),
    ("NOTA DE CRÉDITO N° 001-00012345 - Devolución por producto defectuoso - Importe: $25,000 - Cliente: Juan Pérez S.A.", ["notas_credito"]),
    ("Credit Note #CN-2024-456 - Reintegro por cancelación de servicios - Amount: USD 1,200", ["notas_credito"]),
    ("NOTA DE DÉBITO N° 002-00067890 - Cargo por interés por mora - Importe: $3,500 - Vencimiento: 30/09/2024", ["notas_debito"]),
    ("Debit Note DN-789 - Cargo adicional por servicios extra - Amount: $850 - Account: 1234567890", ["notas_debito"]),
]
GOLDEN = "ORDEN DE PAGO número 123 para pago de servicios por importe de $50000"
LONG = [
    "LIQUIDACIÓN DE GRANOS\nProductor: JUAN PÉREZ\nCUIT: 20-12345678-9\nSOJA CAMPAÑA 2024/25\nPeso Bruto: 25,500 kg\n"
    "Humedad: 14.5%\nPrecio por tonelada: $450,000\nDescuento por humedad: $2,500\nFecha: 15/09/2024",
    "CARTA DE PORTE NACIONAL\nTRANSPORTISTA: TRANSPORTES DEL CAMPO S.R.L.\nChapa del Camión: ABC-123\n"
    "ORIGEN: Campo\nDESTINO: Puerto Rosario\nPeso Estimado: 32,000 kg",
    "CONTRATO DE LOCACIÓN\nPARTES CONTRATANTES\nCLÁUSULAS PARTICULARES\nVIGENCIA DEL CONTRATO\nFIRMA y FECHA",
    "BANCO GALICIA\nCHEQUE Nº 12345678\nFECHA DE EMISIÓN: 18/09/2024\nPÁGUESE A: SERVICIOS S.A.\n$ 35,000.00\n"
    "CUENTA CORRIENTE Nº: 4058-7",
    "EDESUR S.A. CUIT 30-65511620-2 DISTRIBUCIÓN ELÉCTRICA CARGO FIJO KWH CONSUMIDOS factura",
    "EMPRESA del SUR DISTRIBUIDORA de energía", "RECIBO N° 000123 RECIBÍ DE Juan LA SUMA DE pesos EN CONCEPTO DE",
    "BANCO SANTANDER RÍO\nESTADO DE CUENTA\nSALDO FINAL: $ 665,200.00\nMOVIMIENTOS DEL PERÍODO",
    "SUBTOTAL 100\rTOTAL 121 IVA 21% IVA 10.5% IVA 27% IVA 21%", "ORDEN DE COMPRA N° 5 PROVEEDOR: X LUGAR DE ENTREGA",
]
EDGE = [
    None, "", "   \n\t ", "factura", "importe", "Código descripción cantidad", "CÓDIGO DESCRIPCIÓN CANTIDAD",
    "nota\nde   crédito y nota de crédito", "aaaa", "línea uno\r\nremito n° 12\r\n",
    " ".join(["palabra"] * 99 + ["remito"]), " ".join(["palabra"] * 100 + ["remito"]),
    "granos granos granos cereales convenio acuerdo contrato", "kgs 5kg kg. átn tn ars pesos usd,",
    "c.o.t. c.t.g cot", "c.o.t.", "C.T.G", "İstanbul straße FACTURA ſ",
]
ALL = [t for t, _ in EXPECTED] + [GOLDEN] + LONG + EDGE
