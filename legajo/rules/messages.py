"""Texts that results carry."""

# Errors and warnings of a validation; sizes and numbers follow or stand between the two parts.
BAD_EXTENSION = "Extensión no permitida: "
SMALL_FILE = ("Archivo muy pequeño: ", " bytes (mínimo: ")
LARGE_FILE = ("Archivo muy grande: ", " bytes (máximo: ")
BAD_MEDIA_TYPE = "Tipo MIME inesperado: "
FEW_PAGES = ("Muy pocas páginas: ", " (mínimo: ")
MANY_PAGES = ("Demasiadas páginas: ", " (máximo: ")
PASSWORD = "Documento protegido por contraseña"
NO_TEXT = "No se puede extraer texto y no contiene imágenes"
LITTLE_TEXT = "Texto mínimo pero contiene imágenes (posible OCR necesario)"
SHORT_READ = "Inconsistencia en el tamaño del archivo durante lectura"
HARD_TO_READ = "Poco texto extraíble, podría necesitar OCR"

# Parts of the reason of a decision.
AGREEING = "Métodos coincidentes: "
STRONG = ("Consenso fuerte: ", " métodos coinciden")
LEVELS = ("Alta confianza", "Confianza media", "Baja confianza")
DOMAIN_NAMES = {"agro": "agropecuario", "commercial": "comercial"}
SUPPLIER = "Proveedor detectado: "
SHORTCUT = ("Documento ", " detectado con alta confianza (", ") - prioridad automática")
