"""Word lists used as defaults; every operator takes its own lists as parameters.

Fixed values: results must be comparable with the published ones, so that these lists stand as they are.
"""

CAUSAL_CORE = [
    "causó", "provocó", "generó", "produjo", "debido a", "como consecuencia de",
    "resultado de", "gracias a", "por culpa de",
]
CAUSAL_EXTENDED = [
    "causaron", "causa de", "a causa de", "provocaron", "generaron", "produjeron",
    "ocasionó", "ocasionaron", "originó", "originaron", "derivó en", "derivaron en",
    "condujo a", "condujeron a", "llevó a", "llevaron a", "se tradujo en", "se tradujeron en",
    "por efecto de", "como resultado de", "a raíz de", "responsable de", "responsables de",
    "lo que ha llevado a", "esto ha generado", "ha generado", "han generado", "ha provocado",
    "han provocado", "ha causado", "han causado",
]
HEDGING = [
    "podría", "podrían", "pudo", "pudieron", "posible", "posiblemente", "probablemente",
    "aparentemente", "al parecer", "presunto", "presunta", "presuntos", "presuntas",
    "presuntamente", "habría", "habrían", "indicios", "eventual", "eventualmente",
    "se estima", "estimado", "estimada", "aproximadamente", "alrededor de", "cerca de",
    "sugiere", "sugieren", "parece", "parecen", "tendría", "tendrían", "riesgo de",
]
ATTRIBUTION = [
    "según", "de acuerdo con", "señaló", "señalaron", "indicó", "indicaron", "advirtió",
    "advirtieron", "denunció", "denunciaron", "alertó", "alertaron", "reveló", "revelaron",
    "evidenció", "evidenciaron", "documentó", "documentaron", "constató", "constataron",
    "reportó", "reportaron", "informó", "informaron", "reconoció", "reconocieron",
    "afirmó", "afirmaron", "aseguró", "aseguraron", "estableció", "determinó", "concluyó",
    "encontró", "encontramos", "identificó", "identificaron", "identificamos", "registró",
    "registra", "registraba", "reporta", "evidencia", "advierte",
]
POSITIVE = [
    "logro", "logros", "éxito", "exitoso", "avance", "avances", "mejora", "mejoró", "eficiente",
    "eficiencia", "transparencia", "transparente", "rigor", "riguroso", "honesto", "honestidad",
    "fortalecer", "fortalecimiento", "confianza", "cumplimiento", "calidad", "oportuno",
    "responsable", "legítima", "legítimo", "servicio", "restaurar", "proteger", "garantizar",
]
NEGATIVE = [
    "corrupción", "irregular", "irregulares", "irregularidades", "detrimento", "sobrecosto",
    "sobrecostos", "fraude", "crisis", "colapso", "fracaso", "falla", "fallas", "deterioro",
    "pérdida", "pérdidas", "abandono", "negligencia", "desgreño", "despilfarro", "sabotaje",
    "ineficiencia", "parálisis", "riesgo", "riesgos", "deuda", "deudas", "déficit", "incumplimiento",
    "opacidad", "discrecionalidad", "improvisación", "irresponsable", "grave", "graves", "nocivo",
    "nocivos", "destrucción", "captura", "violencia", "criminal", "ilegal", "indebido", "indebida",
]
CERTAINTY = [
    "sin duda", "sin lugar a dudas", "indudablemente", "evidentemente", "es evidente",
    "claramente", "definitivamente", "absolutamente", "totalmente", "demuestra", "demuestran",
    "demostró", "comprobado", "comprobada", "confirma", "confirmó", "irrefutable", "inequívoco",
    "inequívoca", "sin precedentes", "siempre", "nunca", "jamás", "en efecto", "es un hecho",
    "está claro", "verificable", "verificables", "rigurosamente", "sistemáticamente",
]
ADVERSARIAL = [
    "gobierno anterior", "régimen anterior", "gobierno saliente", "administración anterior",
    "administración saliente", "funcionarios salientes", "heredamos", "heredado", "heredada",
    "herencia", "recibimos", "desgreño", "altanera", "saqueo", "despilfarro", "sabotaje",
    "obstáculos", "maquillaje", "ocultar", "oculto", "oculta", "negligencia", "complicidad",
    "irresponsable", "irresponsabilidad", "abandono", "improvisación", "captura", "botín",
]
FRAMES = {
    "crisis": ["crisis", "colapso", "colapsó", "emergencia", "quiebra", "bomba", "catástrofe",
               "catastrófico", "caos", "desastre", "hueco", "déficit"],
    "riesgo": ["riesgo", "riesgos", "amenaza", "amenazas", "vulnerable", "vulnerabilidad",
               "peligro", "exposición", "contingente"],
    "fracaso": ["fracaso", "falla", "fallas", "incumplimiento", "incumplió", "ineficiencia",
                "parálisis", "rezago", "baja ejecución", "sin ejecutar", "inejecución",
                "paralizado", "paralizada", "deterioro", "pérdida", "retraso", "retrasos"],
    "corrupcion": ["corrupción", "corrupto", "corruptas", "irregular", "irregulares",
                   "irregularidades", "sobrecosto", "sobrecostos", "detrimento", "desvío",
                   "fraude", "peculado", "soborno", "sin soportes", "sin soporte",
                   "hallazgo fiscal", "hallazgos fiscales", "hallazgos disciplinarios"],
    "exito": ["logro", "logros", "éxito", "exitoso", "avance", "avances", "mejora", "mejoró",
              "cumplimiento", "cumplió", "fortalecimiento", "eficiencia"],
    "crecimiento": ["crecimiento", "creció", "aumento", "aumentó", "incremento", "incrementó",
                    "se duplicó", "se triplicó", "expansión"],
    "seguridad": ["seguridad", "violencia", "grupos armados", "criminal", "criminales",
                  "narcotráfico", "homicidio", "homicidios", "secuestro", "extorsión",
                  "minería ilegal", "economías ilícitas", "control territorial"],
    "restauracion": ["restaurar", "restauración", "reconstrucción", "reconstruir", "rescate",
                     "rescatar", "patria milagro", "orden", "corregir", "corrección", "recuperar",
                     "transformar"],
}
#: Stems that tell what a statement is about, by type, looked for anywhere in small letters (this project's own choice; a
#: parameter of the operator).
CLAIM_TYPES = {
    "economico": ["pib", "economía", "inflación", "inversión", "exportaci", "importaci", "producción", "productiv", "comercio", "industria",
                  "turismo", "empresa", "agropecuari", "tierra", "hectárea"],
    "corrupcion": ["corrupci", "irregular", "sobrecost", "detrimento", "desvío", "fraude", "peculado", "soborno", "contratación directa"],
    "fiscal": ["presupuest", "déficit", "deuda", "regalías", "recaudo", "billones", "rezago", "hacienda", "fiscal"],
    "empleo": ["empleo", "contratista", "nómina", "trabajador", "planta de personal", "prestación de servicios", "vacantes", "laboral"],
    "seguridad": ["seguridad", "criminal", "narcotráfic", "homicid", "secuestr", "extorsi", "ejército", "policía", "militar"],
    "salud": ["salud", "hospital", "medicament", "pacientes", "clínic", "vacun"],
    "energia": ["energía", "petróle", "hidrocarbur", "tarifa", "eléctric", "transmisión", "generación"],
    "instituciones": ["corte", "procuradur", "contraloría", "fiscalía", "sentencia", "demanda", "litigi", "arbitr", "tutela", "congreso", "decreto", "resolución"],
    "politica_social": ["subsidio", "pobreza", "programa social", "adultos mayores", "niñez", "educación", "colegio", "docentes", "maestros", "indígena"],
    "infraestructura": ["carretera", "obra", "infraestructura", "vivienda", "puerto", "aeropuerto", "acueducto", "transporte"],
    "relaciones_internacionales": ["cancillería", "pasaporte", "embajad", "consulad", "internacional", "exterior"],
}
#: What the name of a section tells about the type, where the words of a statement leave it open; the first that fits holds.
SECTION_TYPES = {
    "Hacienda": "fiscal", "Trabajo": "empleo", "Defensa": "seguridad", "Salud": "salud", "Minas": "energia",
    "Transporte": "infraestructura", "Vivienda": "infraestructura", "Relaciones Exteriores": "relaciones_internacionales",
    "Inclusión Social": "politica_social", "Educación": "politica_social", "Justicia": "instituciones", "Interior": "instituciones",
}
#: Scale words of amounts, the longest first where one holds another.
SCALES = {"mil millones": 1e9, "billones": 1e12, "billón": 1e12, "millones": 1e6, "millón": 1e6, "mil": 1e3}
#: Spanish words that carry little meaning, and those of them that this field needs.
STOPWORDS = [
    "a", "al", "ante", "antes", "así", "aun", "aunque", "bajo", "cada", "casi", "como", "con", "contra", "cual", "cuando", "de", "del", "desde", "donde",
    "dos", "durante", "e", "el", "ella", "ellos", "en", "entre", "era", "es", "esa", "ese", "eso", "esta", "estado", "este", "esto", "fue", "general", "gran", "ha",
    "hasta", "hay", "la", "las", "le", "lo", "los", "más", "mayor", "menos", "mismo", "muy", "no", "nos", "nuevo", "o", "otra", "otro", "para", "parte", "pero",
    "por", "porque", "primera", "que", "se", "según", "ser", "si", "sin", "sobre", "son", "su", "sus", "también", "tan", "todo", "todos", "total", "trabajo", "tres", "un",
    "una", "uno", "valor", "y", "ya",
]
KEPT_WORDS = ["estado", "general", "mayor", "menos", "nuevo", "parte", "primera", "total", "trabajo", "valor", "según", "sin", "no"]
#: Who acts, in sentences about causes.
ACTORS = ["gobierno", "administración", "administracion", "régimen", "ministerio", "ministeria", "ministro", "ministra", "presidente", "petro",
          "gerente", "director", "funcionario", "funcionaria", "funcionarios", "funcionarias", "entidad"]
FUNCTION_WORDS = [
    "de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no",
    "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si",
    "sin", "sobre", "este", "ya", "entre", "cuando", "todo", "esta", "ser", "son", "dos", "también",
    "fue", "había", "era", "muy", "hasta", "desde", "está", "mi", "porque", "qué", "sólo", "solo",
    "han", "yo", "hay", "vez", "puede", "todos",
]
CONNECTORS = [
    "además", "sin embargo", "por lo tanto", "por tanto", "en consecuencia", "asimismo", "no obstante",
    "por otra parte", "de igual forma", "de igual manera", "en este sentido", "por ello", "por eso",
    "es decir", "en efecto", "finalmente", "en suma", "en síntesis", "por su parte", "a su vez",
    "en particular", "en otras palabras", "así mismo", "igualmente", "de hecho", "mientras tanto",
]
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "setiembre", "octubre", "noviembre", "diciembre"]
#: Weights of the cues of a checkable statement, and the score from which it is one.
CUE_WEIGHTS = {"money": 3, "percent": 3, "number": 2, "date": 1, "comparative": 1, "ranking": 1, "causal": 1, "institution": 1, "attribution": 1, "law": 1}
FACTUAL_THRESHOLD = 3
#: Source types from the strongest to the weakest.
SOURCE_PRIORITY = [
    "raw_official_dataset", "official_statistical_publication", "legislation_or_official_document", "peer_reviewed_research",
    "multilateral_organisation", "independent_research", "reputable_journalism", "commentary", "social_media",
]
ANALYTIC_BLOCKS = ["body", "subheading", "list_item", "quote", "footnote", "caption", "figure_ocr"]
