"""Configuration of the engine.

All wording, screens and thresholds live here, so a different programme is a
different :class:`ProgressConfig` and no code change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: must stay as they are for results to be right. -----------

# Texts that stand for "no value" (trimmed, any case).
MISSING_TOKENS = ("", "nat", "nan", "none")

# Funnel status -> ordered funnel label.
STATUS_LABELS = {
    "Rechazo / Sin disponibilidad": "1. Rechazo / Sin disponibilidad",
    "Recién Notificado (< 5 días)": "2. Recién Notificados",
    "Notificado - No Descarga App": "3. Notificados No Descargan",
    "Notificado con Error Técnico": "4. Notificados con Error Técnico",
    "En Progreso - Atrasado": "5. En Progreso Atrasados",
    "En Libro 1": "6. En Libro 1",
    "En Progreso - Empezando Libro 2": "7. Empezando Libro 2",
    "En Progreso - Próximo a Terminar (Avanzado)": "8. Próximos a Terminar (Avanzados)",
    "Completado": "9. Completados",
}
UNKNOWN = "Desconocido"

# Sections in the order a participant walks through them, with their labels.
SECTION_LABELS = {
    "L1B1S0": "L1 - Mapa misiones",
    "L1B2S1": "L1 - Lectura 1 Adentro",
    "L1B3S1": "L1 - Actividad 1 Adentro",
    "L1B2S2": "L1 - Lectura 2 Adentro",
    "L1B3S2": "L1 - Actividad 2 Adentro",
    "L1B2S3": "L1 - Lectura 3 Adentro",
    "L1B3S3": "L1 - Actividad 3 Adentro",
    "L1B3S4": "L1 - Recontado Adentro",
    "L2B1S0": "L2 - Mapa misiones",
    "L2B2S1": "L2 - Lectura 1 Nibaldo",
    "L2B3S1": "L2 - Actividad 1 Nibaldo",
    "L2B2S2": "L2 - Lectura 2 Nibaldo",
    "L2B3S2": "L2 - Actividad 2 Nibaldo",
    "L2B2S3": "L2 - Lectura 3 Nibaldo",
    "L2B3S3": "L2 - Actividad 3 Nibaldo",
    "L2B3S4": "L2 - Recontado Nibaldo",
}

# Reaching one of these screens completes the programme.
FINAL_SCREENS = ("L2B3S4_15",)

# Names of the screens worth naming.
SCREEN_LABELS = {
    "L1B1S0_15": "Mapa de misiones libro 1",
    "L2B1S0_14": "Retomar sesión (2)",
    "L1B1S0_16": "Retomar sesión sin pregunta",
    "L1B2S1_2L21": "Final primera lectura Adentro",
    "L1B2S1_3": "Inicio primera actividad Adentro",
    "L1B3S1_33": "Final primera actividad Adentro",
    "L1B2S2_2L21": "Final segunda lectura Adentro",
    "L1B2S2_3": "Inicio segunda actividad Adentro",
    "L1B3S2_9": "Termina segunda actividad Adentro",
    "L1B2S3_2L21": "Final tercera lectura Adentro",
    "L1B2S3_3": "Inicio tercera actividad Adentro",
    "L1B3S3_15": "Termina tercera actividad Adentro",
    "L1B3S4_14": "Termina actividad recontado Adentro",
    "L1B3S4_15": "Encuesta final Adentro",
    "L2B2S1_2L21": "Final primera lectura Nibaldo",
    "L2B2S1_3": "Inicio primera actividad Nibaldo",
    "L2B3S1_33": "Final primera actividad Nibaldo",
    "L2B2S2_2L21": "Final segunda lectura Nibaldo",
    "L2B2S2_3": "Inicio segunda actividad Nibaldo",
    "L2B3S2_9": "Termina segunda actividad Nibaldo",
    "L2B2S3_2L21": "Final tercera lectura Nibaldo",
    "L2B2S3_3": "Inicio tercera actividad Nibaldo",
    "L2B3S3_15": "Termina tercera actividad Nibaldo",
    "L2B3S4_14": "Termina actividad recontado Nibaldo",
    "L2B3S4_15": "Encuesta final Nibaldo",
}

# Log entries that are not real use of the app (regular expressions, any case).
NOISE_PATTERNS = (
    "env[ií]o de notificaci[oó]n por inactividad",
    "notificaci[oó]n de inactividad",
    "recordatorio autom[aá]tico",
    "push notification",
    "system alert",
)

# Words in the operator's free-text state.
REJECTION_WORDS = (
    "no tiene tiempo",
    "no quieren",
    "no quiere",
    "no puede",
    "rechaz",
    "desist",
    "baja",
    "fuera",
)
ERROR_WORDS = ("error",)
FALSE_COMPLETION_WORDS = ("falso", "no completado")

# A contact in this state may be added to the roster.
ELIGIBLE_CONTACT_STATE = "participante"

# Statuses that count as active.
ACTIVE_STATUS_PATTERN = "En Progreso|Libro|Llamar"

# Call list -> statuses on it.
CALL_LISTS = {
    "late": ("En Progreso - Atrasado",),
    "no_download": ("Notificado - No Descarga App",),
    "confirm_completed": ("Completado", "En Progreso - Próximo a Terminar (Avanzado)"),
}

# Status wording -> badge, the first match counts.
BADGES = {
    "Completado": "completed",
    "Atrasado": "late",
    "Próximo": "near_end",
    "Error": "error",
    "Rechazo": "rejected",
}
OTHER_BADGE = "other"

NO_ACTIVITY = "Sin actividad"

# Whether a participant can be evaluated, before the day.
EVALUABLE_SINCE = "SÍ, DESDE EL "
EVALUABLE_FROM = "NO, SE PODRÁ EL "

# Cohort buckets: weeks since enrolment, the last one is open-ended.
COHORT_LABELS = (
    "Semana 0 (0-6d)",
    "Semana 1 (7-13d)",
    "Semana 2 (14-20d)",
    "Semana 3 (21-27d)",
    "Semana 4 (28-34d)",
    "Semana 5 (35-41d)",
    "Semana 6 (42-48d)",
    "Semana 7+ (49d+)",
)

# Roster sheet header -> column name used here.
PARTICIPANT_HEADERS = {
    "ID": "id",
    "Colegio": "school",
    "Nombre adulto": "adult_name",
    "1er apellido adulto": "adult_surname",
    "Teléfono": "phone",
    "Estado": "state",
    "Fecha de inscripción en el servidor": "enrolled_at",
    "Fecha log en app": "first_log_at",
    "Fecha log (solo día y mes)": "first_log_date",
    "CUMPLE 4 SEMANAS EL": "week4_on",
    "CUMPLE LAS 6 SEMANAS EL": "week6_on",
    "Evaluable a las 4 semanas": "week4_eval",
    "Evaluable a las 6 semanas": "week6_eval",
    "Fecha último uso": "last_used_at",
    "Días desde último uso": "days_since_use",
    "Días Transcurridos": "days_elapsed",
    "Fecha Esperada Finalización": "expected_end_at",
    "Fecha Finalización Real": "finished_at",
    "Pantalla Actual": "current_screen",
    "% Progreso": "progress_pct",
    "Completado": "completed",
    "Status Clasificado": "status",
    "Status Ordenado": "status_ordered",
    "Etapa del Embudo": "funnel_stage",
    "Comentarios": "comments",
}

# Log report header -> column name used here.
LOG_HEADERS = {
    "Numero Telefono": "phone",
    "HoradeEntradaPantalla": "entered_at",
    "IDPantalla": "screen",
    "Registro": "entry",
}

# Contact sheet position -> column name used here.
CONTACT_POSITIONS = {
    0: "id",
    1: "school",
    2: "adult_name_1",
    3: "adult_name_2",
    4: "adult_name_3",
    5: "child_name_1",
    6: "child_name_2",
    7: "child_name_3",
    10: "phone",
    24: "contact_state",
}

# Rows above the header row in the two sheets.
ROSTER_SKIP = 2
CONTACTS_SKIP = 13

# --- End of the fixed values. ------------------------------------------------


@dataclass(frozen=True)
class Statuses:
    """The wording of each funnel status; the order of the funnel is that of ``ProgressConfig.status_labels``."""

    rejected: str = "Rechazo / Sin disponibilidad"
    recent: str = "Recién Notificado (< 5 días)"
    absent: str = "Notificado - No Descarga App"
    failed: str = "Notificado con Error Técnico"
    late: str = "En Progreso - Atrasado"
    first_half: str = "En Libro 1"
    second_half: str = "En Progreso - Empezando Libro 2"
    near_end: str = "En Progreso - Próximo a Terminar (Avanzado)"
    done: str = "Completado"


@dataclass(frozen=True)
class ProgressConfig:
    """What one programme looks like; the defaults are the fixed values above."""

    statuses: Statuses = field(default_factory=Statuses)
    unknown: str = UNKNOWN
    no_activity: str = NO_ACTIVITY
    eligible_contact_state: str = ELIGIBLE_CONTACT_STATE
    evaluable_since: str = EVALUABLE_SINCE
    evaluable_from: str = EVALUABLE_FROM
    badges: dict[str, str] = field(default_factory=lambda: dict(BADGES))
    other_badge: str = OTHER_BADGE
    cohort_labels: tuple[str, ...] = COHORT_LABELS

    section_labels: dict[str, str] = field(default_factory=lambda: dict(SECTION_LABELS))
    screen_labels: dict[str, str] = field(default_factory=lambda: dict(SCREEN_LABELS))
    final_screens: tuple[str, ...] = FINAL_SCREENS
    status_labels: dict[str, str] = field(default_factory=lambda: dict(STATUS_LABELS))
    call_lists: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CALL_LISTS))

    noise_patterns: tuple[str, ...] = NOISE_PATTERNS
    rejection_words: tuple[str, ...] = REJECTION_WORDS
    error_words: tuple[str, ...] = ERROR_WORDS
    false_completion_words: tuple[str, ...] = FALSE_COMPLETION_WORDS
    active_status_pattern: str = ACTIVE_STATUS_PATTERN

    expected_days: int = 14
    week4_days: int = 28
    week6_days: int = 42
    recent_days: int = 5
    near_end_pct: float = 75.0
    second_half_pct: float = 50.0
    false_completion_pct: float = 93.8
    retained_versions: int = 3

    # Read year-first text of the loose shapes with the day before the month.
    dayfirst_fallback: bool = True

    @property
    def sections(self) -> list[str]:
        """Sections in walking order."""
        return list(self.section_labels)


DEFAULT_CONFIG = ProgressConfig()
