"""Values that results depend on: word lists, patterns, constants, phrases.

All of them are fixed values, stated as the domain has them (a Spanish engineering school's web).
Patterns are written for Python's ``re``; :func:`ragframe.functions.text.java` adds Java's flags.
"""

# --- fixed values: sizes and thresholds -------------------------------------------------------
CHARS_PER_TOKEN = 4
CHUNK_TOKENS, OVERLAP_TOKENS, MIN_CHUNK_TOKENS = 512, 50, 64
CLEAN_MIN_CHARS, CORPUS_MIN_CHARS, RECORD_MIN_CHARS = 80, 200, 15
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, K_CANDIDATES, K_FINAL, K_FINAL_LISTING = 60, 50, 5, 10
SIMILARITY_THRESHOLD, HYBRID_FACTOR, MMR_LAMBDA, OFF_CATEGORY_PENALTY = 0.35, 0.7, 0.7, 1.5
SIGLA_BOOST, SUMMARY_BOOST = 1.6, 1.3
GATE_HIGH, GATE_LOW = 2.0, -1.0
DEDUP_THRESHOLD, RECOVER_THRESHOLD, MIN_SHARED = 0.5, 0.3, 3
SEPARATORS = ("\n\n", "\n", ". ", " ")
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "

# --- fixed values: cleaning ----------------------------------------------------------------------
BOILERPLATE = (
    r"Aceptar cookies?",
    r"Pol[ií]tica de privacidad",
    r"© Universidad de Granada",
    r"Aviso legal",
    r"Mapa del sitio",
    r"Breadcrumb",
    r"Ir al contenido principal",
)
BOILERPLATE_AT_START = r"^Inicio\s*>"  # case matters
FORM_INDICATORS = r"D\.N\.I\.|Apellido\s*1|Firma\s+del|Firma$|Impreso\s+de\s+solicitud|Modelo\s+de\s+solicitud"
NOISE_TAGS = ("nav", "footer", "header", "aside", "script", "style", "noscript", "form", "button", "svg")
NOISE_KEYWORDS = (
    "protección de datos", "proteccion de datos", "protecciondedatos",
    "cláusulas informativas", "clausulas informativas",
    "información adicional sobre", "informacion adicional sobre",
    "comunicación de brechas", "comunicacion de brechas",
    "ejercicio de derechos", "infografía", "infografias",
    "recomendaciones e infografías",
)
OLD_EXAM_NAMES = ("Asignación Aulas", "CalendarioExamenes", "Calendario Academico", "Calendario TFG")
CURRENT_YEAR_NAMES = ("25-26", "2025-2026")
EXPECTED_CATEGORIES = ("calendario", "estudiantes", "guias_docentes", "movilidad", "normativa", "profesorado", "tfg", "tramites")
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")
MONTHS_SHORT = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

# --- fixed values: tokens ---------------------------------------------------------------------------
BM25_TOKEN = r"[a-záéíóúüñ0-9]+"
STOPWORDS = (
    "de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "en", "y", "o", "a", "al", "es", "son", "para", "por", "con",
    "su", "sus", "lo", "se", "que", "como", "más", "mas", "este", "esta", "estos", "estas", "the", "of", "horas", "hora",
)

# --- fixed values: subjects -------------------------------------------------------------------------
SUBJECTS = {
    "CA": "Cálculo",
    "FFT": "Fundamentos Físicos y Tecnológicos",
    "FP": "Fundamentos de Programación",
    "FS": "Fundamentos del Software",
    "ALEM": "Álgebra Lineal y Estructuras Matemáticas",
    "EST": "Estadística",
    "IES": "Ingeniería, Empresa y Sociedad",
    "LMD": "Lógica y Métodos Discretos",
    "MP": "Metodología de la Programación",
    "TOC": "Tecnología y Organización de Computadores",
    "EC": "Estructura de Computadores",
    "ED": "Estructura de Datos",
    "PDOO": "Programación y Diseño Orientado a Objetos",
    "SCD": "Sistemas Concurrentes y Distribuidos",
    "SO": "Sistemas Operativos",
    "ALG": "Algorítmica",
    "AC": "Arquitectura de Computadores",
    "FBD": "Fundamentos de Bases de Datos",
    "FIS": "Fundamentos de Ingeniería del Software",
    "IA": "Inteligencia Artificial",
    "DDSI": "Diseño y Desarrollo de Sistemas de Información",
    "FR": "Fundamentos de Redes",
    "IG": "Informática Gráfica",
    "IS": "Ingeniería de Servidores",
    "MC": "Modelos de Computación",
    "SG": "Sistemas Gráficos",
    "SMM": "Sistemas Multimedia",
    "DI": "Derecho Informático",
    "EISI": "Ética, Informática y Sociedad de la Información",
    "CEGE": "Creación de Empresas y Gestión Emprendedora",
    "DIU": "Diseño de Interfaces de Usuario",
    "DGP": "Dirección y Gestión de Proyectos",
    "IV": "Infraestructura Virtual",
    "MDA": "Metodologías de Desarrollo Ágil",
    "MH": "Metaheurísticas",
    "NPI": "Nuevos Paradigmas de Interacción",
    "VC": "Visión por Computador",
    "RI": "Recuperación de Información",
    "TSI": "Técnicas de los Sistemas Inteligentes",
    "AA": "Aprendizaje Automático",
    "IC": "Ingeniería del Conocimiento",
    "SWAP": "Servidores Web de Altas Prestaciones",
    "DAI": "Desarrollo de Aplicaciones para Internet",
    "DS": "Desarrollo de Software",
    "SSO": "Seguridad en Sistemas Operativos",
    "PPR": "Programación Paralela",
    "PW": "Programación Web",
    "TW": "Tecnologías Web",
    "SIBW": "Sistemas de Información Basados en Web",
    "IN": "Inteligencia de Negocio",
    "TFG": "Trabajo Fin de Grado",
}
SIGLA = r"\b([A-ZÁÉÍÓÚÑ]{2,6})\b"

# --- fixed values: routing rules (name, pattern, boosts) ---------------------------------------------
ROUTES = (
    (
        "plan_estudios",
        r"(?:plan\s+de\s+estudios|asignaturas?\s+(?:del?\s+)?(?:primer|segund|tercer|cuart|1|2|3|4)"
        r"|(?:primer|segund|tercer|cuart)\s+(?:curso|año)"
        r"|materias?\s+(?:del?\s+)?(?:grado|carrera)"
        r"|créditos?\s+(?:del?\s+)?grado|estructura\s+del\s+grado|optativas?\s+(?:del?\s+)?grado"
        r"|especialidades?\s+(?:del?\s+)?(?:grado|informática)"
        r"|(?:asignaturas?|materias?|optativas?)\b[^|]{0,40}\bespecialidad"
        r"|\bespecialidad(?:es)?\b[^|]{0,25}\b(?:primer|segund|tercer|cuart|\d\s*º|grado|inform[aá]tica)"
        r"|(?:cada|todas?\s+las?)\s+especialidad"
        r"|(?:qu[eé]|cu[aá]les|cu[aá]ntas)\s+(?:son\s+las\s+)?especialidades)",
        {"plan_estudios": 2.5, "presentacion_grado": 1.5, "horarios": 1.3},
    ),
    ("cuatrimestre", r"(?:cuatrimestre|semestre)", {"horarios": 2.0, "plan_estudios": 1.5}),
    (
        "tfg",
        r"(?:tfg|trabajo\s+fin\s+de\s+grado|proyecto\s+fin\s+de\s+grado|defensa\s+(?:del?\s+)?tfg|tribunal\s+tfg"
        r"|memoria\s+(?:del?\s+)?tfg|tutor\s+(?:del?\s+)?tfg|convocatoria\s+(?:del?\s+)?tfg)",
        {"tfg": 2.5, "normativa": 1.3, "calendario": 1.5},
    ),
    (
        "calendario",
        r"(?:cuándo|cuando|fecha|plazo|calendario|entrega|convocatoria|examen|exámenes|periodo|matrícula|def(?:en|ien)\w*"
        r"|(?:junio|septiembre|noviembre|febrero)\s+\d{4})",
        {"calendario": 2.0, "tramites": 1.2},
    ),
    (
        "movilidad",
        r"(?:erasmus|movilidad|intercambio|sicue|destino|universidad\s+de\s+destino|beca\s+erasmus|contrato\s+de\s+estudios|learning\s+agreement)",
        {"movilidad": 2.5},
    ),
    (
        "tramites",
        r"(?:secretaría|secretaria|impreso|formulario|solicitud|solicitar|certificado|título|automatrícula|anulación|traslado"
        r"|reconocimiento\s+de\s+créditos|horario\s+(?:de\s+)?(?:la\s+)?(?:secretaría|secretaria|atención))",
        {"tramites": 2.0, "normativa": 1.2},
    ),
    (
        "normativa",
        r"(?:normativa|reglamento|directrices|resolución|regulación|normas?\s+(?:de|del)\s+(?:evaluación|permanencia|tfg))",
        {"normativa": 2.5},
    ),
    (
        "practicas",
        r"(?:prácticas?\s+(?:en\s+)?empresa|prácticas?\s+externas?|curriculares|extracurriculares|convenio\s+de\s+prácticas)",
        {"tramites": 2.0, "estudiantes": 1.5},
    ),
    (
        "horarios",
        r"(?:a\s+qué\s+hora|(?:qué|en\s+qué)\s+aula|clases?\s+de\s+(?!la\s+secretar)\w+|horarios?\s+de\s+(?:las?\s+)?(?:clase|asignatura)"
        r"|horarios?\s+de\s+(?!.*(?:secretar|ex[áa]men))\w+)",
        {"horarios": 2.5, "calendario": 1.2},
    ),
    (
        "guia_docente",
        r"(?:guía\s+docente|programa\s+de\s+(?:la\s+)?asignatura|competencias?\s+de\s+(?:la\s+)?asignatura|temario\s+de|bibliografía\s+de"
        r"|(?:profesor|profesora)\s+de\s+\w+)",
        {"guias_docentes": 2.0},
    ),
    (
        "profesorado",
        r"(?:profesor|profesora|profesorado|docente|departamento|despacho|tutorías?\s+(?:del?\s+)?profesor|dirección\s+(?:del?\s+)?centro|decano|subdirector)",
        {"profesorado": 2.0},
    ),
)

# --- fixed values: intents ---------------------------------------------------------------------------
LISTING = (
    r"\b(?:lista|listado|enumera|enum[eé]rame|dame\s+(?:la\s+)?lista)\b",
    r"\b(?:cu[aá]les\s+son|qu[eé]\s+(?:asignaturas?|materias?|optativas?))\b",
    r"\b(?:todas?\s+las?|todos?\s+los?)\s+(?:asignaturas?|materias?|optativas?|cr[eé]ditos?)\b",
    r"\b(?:asignaturas?|materias?|optativas?)\b.{0,40}\b(?:curso|cuatrimestre|semestre|especialidad|menci[oó]n|grado|primer|segund|tercer|cuart|\d\s*º)\b",
    r"\b(?:primer|segund|tercer|cuart|\d\s*º)\b.{0,40}\b(?:asignaturas?|materias?|optativas?)\b",
    r"\bqu[eé]\s+se\s+(?:imparte|cursa|estudia|da)\b",
    r"\b(?:todos?\s+los|cada|de\s+todos?\s+los)\s+grupos?\b",
    r"\btodos?\s+los\s+grupos?\b",
)
TIMETABLE_INTENT = r"\b(?:horario|clase|clases|a\s+qu[eé]\s+hora|aula|teor[ií]a|pr[aá]cticas?)\b"
EXAM_INTENT = r"\b(?:examen|ex[aá]menes|examina|examinar|convocatoria|ordinaria|extraordinaria)\b"
COURSE_WORD, COURSE_DIGIT = r"\b(primer|segund|tercer|cuart)", r"\b([1-4])\s*º?\b"
ANAPHORIC = r"^\s*(?:¿\s*)?(?:y\b|me\s+(?:refier[oa]|refer[ií]a)|quer[ií]a\s+decir|tambi[eé]n|adem[aá]s|igualmente|otra\s+vez)"
GROUP, GROUP_BARE, GROUP_LETTER = r"\bgrupo\s+([1-4]\s*º?\s*[A-H])\b", r"\b([1-4]\s*º\s*[A-H])\b", r"\bgrupo\s+([A-H])\b"
SUBGROUP, PRACTICE, THEORY = r"\bsubgrupo\s+([A-H]?\s*[1-9])\b", r"\bpr[aá]cticas?\b", r"\bteor[ií]a\b"
META = (
    r"\b(?:qui[eé]n\s+eres|qu[eé]\s+eres|c[oó]mo\s+te\s+llamas|qu[eé]\s+(?:puedes|sabes)\s+hacer|para\s+qu[eé]\s+sirves"
    r"|qui[eé]n\s+te\s+(?:cre[oó]|hizo|program[oó]|desarroll[oó]))\b"
)

# --- fixed values: records -----------------------------------------------------------------------------
RECORD_COURSE, RECORD_COURSE_WORD = r"(\d)\s*º", r"\b(primer|segundo|tercer|cuarto)\s+curso"
RECORD_GROUP = r"\b\d\s*º\s*([A-H])(?![a-zñáéíóú])"
RECORD_SPECIALITY, PLAN_SPECIALITY = r"Inform[aá]tica\s*\(([^)]+)\)", r"especialidad\s+[^()|]+\(([A-Z]{2,4})\)"
RECORD_TERM = r"(1er|primer|1\s*º|2\s*º|2[o]|segundo)\.?\s*cuatrimestre"
RECORD_DAY, RECORD_HOUR, RECORD_ROOM = r"\b(Lunes|Martes|Mi[ée]rcoles|Jueves|Viernes)\b", r"(\d{1,2}:\d{2}-\d{1,2}:\d{2})", r"aula\s+(.+?)\.?\s*$"
RECORD_SIGLA, RECORD_SUMMARY = r"\(([A-ZÁÉÍÓÚÑ]{2,6})\)", r"\|\s*Asignaturas\s*:"
DAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes")
SLOT_PRACTICE = r"(Lunes|Martes|Miércoles|Jueves|Viernes) (\d{1,2}:\d{2})-(\d{1,2}:\d{2}) \((aula [^)]+)\), \1 \3-(\d{1,2}:\d{2}) \(\4\)"
SLOT_THEORY = r"(Lunes|Martes|Miércoles|Jueves|Viernes) (\d{1,2}:\d{2})-(\d{1,2}:\d{2}), \1 \3-(\d{1,2}:\d{2})"
GRID_TITLE = r"\d\s*º.*Grado\s+en\s+Ingenier[ií]a\s+Inform[aá]tica"
GRID_TERM = r"(?:1er|2[ºo]|primer|segundo|1|2)\.?\s*cuatrimestre"
GRID_TIME, GRID_GROUP, GRID_SUBJECT = r"^\d{1,2}:\d{2}-\d{1,2}:\d{2}$", r"^\([A-Z]?\d\)$", r"^[A-ZÁÉÍÓÚÑ]{2,6}\d?$"
GRID_ROOM = r"^-?\d{1,2}\.\d{1,2}(?:[/-]\d{1,2}(?:\.\d{1,2})?)?$|^[A-Z]\.\d{1,2}$"
LEGEND_SIGLA, LEGEND_WORD = r"^[A-ZÁÉÍÓÚÑ]{2,6}[.:]?$", r"^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}"

# --- fixed values: answers -----------------------------------------------------------------------------
PREAMBLE = (
    r"^\s*la pregunta del usuario\b.*$",
    r"^\s*seg[uú]n (?:los|el|la)\s+fragmento.*$",
    r"^\s*(?:tras|despu[eé]s de)\s+revisar.*$",
    r"^\s*para responder( a)? (?:a )?(?:esta|la) pregunta.*$",
    r"^\s*(?:voy a|necesito)\s+(?:buscar|revisar|analizar).*$",
    r"^\s*bas[aá]ndome en (?:el|los) (?:contexto|fragmento).*$",
    r"^\s*(?:analizando|revisando) (?:el|los) (?:contexto|fragmento).*$",
    r"^\s*la respuesta (?:a (?:tu|la|su|esta) pregunta|final)\b[^:]*:?\s*$",
    r"^\s*(?:la informaci[oó]n|esto) se (?:puede |podr[ií]a )?(?:encontrar|encuentr[ae]).*fragmento.*$",
    r"^\s*(?:seg[uú]n|en|de acuerdo con) (?:el|los) fragmento[s]?\s*\[?\d*\]?\b.*$",
)
TRAILING = (
    r"^\s*espero que (?:esto|esta|le|te).*$",
    r"^\s*si (?:tiene|tienes|necesita|necesitas|desea|deseas|quiere|quieres)\b.*$",
    r"^\s*(?:no dude|no dudes) en (?:preguntar|consultar).*$",
    r"^\s*qued[oó] a su disposici[oó]n.*$",
    r"^\s*puedo (?:ayudarte|ayudarle|sugerir).*$",
    r"^\s*(?:tambi[eé]n )?puedes? (?:consultar|revisar|buscar).*$",
    r"^\s*la respuesta final es\b.*$",
    r"^\s*(?:esto |esta informaci[oó]n )?se (?:puede |podr[ií]a )?(?:encontrar|encuentr[ae]).*fragmento.*$",
    r"^\s*ambos fragmentos\b.*$",
)
LEADING_HEDGE = (
    r"^\s*(?:seg[uú]n\s+(?:la\s+|lo\s+|los\s+|el\s+)?(?:informaci[oó]n|datos?|contexto|indicado|mencionado|proporcionad[oa]s?|disponible)[^,.:]*"
    r"|de\s+acuerdo\s+con\s+(?:la\s+)?informaci[oó]n[^,.:]*|bas[aá]ndome\s+en\s+(?:la\s+)?informaci[oó]n[^,.:]*)[,:.]?\s+"
)
LEADING_META = r"^\s*la\s+respuesta\s+(?:a\s+(?:la|esta|tu|su)\s+pregunta\s+)?(?:es|ser[ií]a)\s*:?\s+"
ABSTENTION = "No dispongo de información suficiente sobre este tema. Le recomiendo consultar con la Secretaría de la ETSIIT."
ABSTENTION_START = (
    r"^\s*(?:(?:lo\s+siento|lamentablemente|disculpe|por\s+desgracia)[,.\s]*(?:pero)?[,.\s]*)?"
    r"(?:no\s+(?:dispongo\s+de|tengo(?:\s+acceso\s+a)?|hay|cuento\s+con|puedo\s+(?:proporcionar|ofrecer|dar|facilitar|responder(?:le)?\s+a))"
    r"\s+(?:[\wáéíóúñ]+\s+){0,4}?(?:informaci[oó]n|datos)"
    r"|no\s+se\s+(?:encuentra|dispone\s+de|proporciona|especifica|menciona|indica|facilita)\s+(?:suficiente\s+)?(?:informaci[oó]n|datos)"
    r"|sin\s+informaci[oó]n\s+(?:suficiente|disponible))"
)
NO_INFO = (
    r"no\s+(?:dispongo\s+de|tengo(?:\s+acceso\s+a)?|hay)\s+(?:suficiente\s+)?(?:informaci[oó]n|datos)|no\s+se\s+menciona"
    r"|no\s+(?:dispongo|cuento)\s+con\s+(?:informaci[oó]n|datos)"
)
DECLINE = (
    r"no\s+puedo\s+(?:emitir|dar|ofrecer|opinar|recomendar|aconsejar|valorar|posicionarme|decantarme)"
    r"|no\s+(?:doy|emito|hago)\s+(?:opiniones|recomendaciones|valoraciones)"
)
LEAKS = (
    r"la pregunta del usuario", r"tras revisar", r"después de revisar", r"necesito buscar", r"voy a buscar",
    r"en los fragmentos proporcionados", r"puedo sugerir", r"algunas opciones", r"pasos? para",
)
CLOSINGS = (
    "¿Puedo ayudarle en algo más?",
    "¿Hay algo más en lo que pueda echarle una mano?",
    "Si necesita cualquier otra cosa, aquí estoy.",
    "Cualquier otra duda, dígamelo sin problema.",
    "Encantado de ayudarle con lo que necesite.",
    "¿Quiere que mire alguna otra cosa por usted?",
)
