"""Rule-based explanations as table columns: lists built from conditions, no row-wise code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import band, urgency
from .fmt import fixed


def _listed(*entries: tuple[Column, Column | str], otherwise: Column | None = None) -> Column:
    """The texts whose condition holds, in order; ``otherwise`` when none does."""
    texts = F.filter(
        F.array(*[F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in entries]),
        lambda t: t.isNotNull(),
    )
    return texts if otherwise is None else F.when(F.size(texts) > 0, texts).otherwise(otherwise)


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---- fixed values: sentences and plans ----
_PLAN_CRITICAL = (
    "DÍA 1-2: Inspección inmediata y evaluación de estado",
    "DÍA 3-4: Adquisición urgente de repuestos críticos",
    "DÍA 5-6: Programación de parada y preparación de taller",
    "DÍA 7: Ejecución de mantenimiento mayor",
    "DÍA 8-10: Pruebas y puesta en servicio",
)
_PLAN_HIGH = (
    "SEMANA 1: Diagnóstico detallado y evaluación de criticidad",
    "SEMANA 1-2: Gestión de repuestos y recursos",
    "SEMANA 2: Coordinación con operaciones para parada programada",
    "SEMANA 3: Ejecución de mantenimiento preventivo/correctivo",
    "SEMANA 3-4: Verificación y retorno a operación normal",
)
_PLAN_NORMAL = (
    "SEMANA 1-2: Planificación detallada de intervención",
    "SEMANA 3-4: Adquisición de repuestos y materiales",
    "SEMANA 5-6: Coordinación con cronograma operativo",
    "SEMANA 7-8: Ejecución de mantenimiento programado",
    "SEMANA 9: Análisis post-mantenimiento y lecciones aprendidas",
)
_CRITICAL_PARTS = (
    "Componentes de desgaste principal del sistema",
    "Elementos de filtración y lubricación",
    "Piezas con histórico de falla frecuente",
)


def explain_fr30(df: DataFrame) -> DataFrame:
    """Needs risk_30d, tbf_dias, tbf_med_60d, ingresos_30d, mttr_eq, sistema_count_60d."""
    risk = F.col("risk_30d")
    tbf, usual = F.col("tbf_dias"), F.col("tbf_med_60d")
    n30, mttr, again = F.col("ingresos_30d"), F.col("mttr_eq"), F.col("sistema_count_60d")
    tests = (
        (tbf > 0) & (usual > 0) & (tbf < usual * 0.7),
        n30 >= 2,
        mttr > 48,
        again >= 2,
    )
    drivers = _listed(
        (
            tests[0],
            F.concat(
                F.lit("TBF actual ("),
                fixed(tbf, 0),
                F.lit(" días) significativamente menor al histórico ("),
                fixed(usual, 0),
                F.lit(" días)"),
            ),
        ),
        (tests[1], F.concat(F.lit("Alta frecuencia de ingresos recientes: "), n30, F.lit(" en 30 días"))),
        (
            tests[2],
            F.concat(
                F.lit("MTTR elevado ("),
                fixed(mttr, 0),
                F.lit(" horas) indica complejidad de reparaciones"),
            ),
        ),
        (
            tests[3],
            F.concat(F.lit("Reincidencia en mismo sistema: "), again, F.lit(" veces en 60 días")),
        ),
        otherwise=F.array(
            F.when(risk < 0.3, "Operación estable con patrones normales de falla").otherwise(
                "Múltiples factores menores contribuyen al riesgo"
            )
        ),
    )
    actions = (
        F.when(
            risk >= 0.5,
            _texts(
                "Inspección inmediata de sistemas críticos",
                "Verificar disponibilidad de repuestos prioritarios",
            ),
        )
        .when(
            risk >= 0.3,
            _texts("Programar inspección preventiva", "Revisar historial de mantenimiento"),
        )
        .otherwise(_texts("Continuar con programa normal de mantenimiento"))
    )
    verdict = (
        F.when(risk >= 0.5, "Requiere atención inmediata.")
        .when(risk >= 0.3, "Monitoreo recomendado.")
        .otherwise("Operación normal.")
    )
    return df.withColumns(
        {
            "resumen": F.concat(
                F.lit("Equipo "),
                F.col("codigo"),
                F.lit(" presenta riesgo de falla 30d = "),
                fixed(risk, 2),
                F.lit(". "),
                verdict,
            ),
            "drivers": F.slice(drivers, 1, 3),
            "acciones_1_2_sem": actions,
            "factores_influyentes": F.struct(
                tbf.alias("tbf_actual"),
                n30.alias("ingresos_recientes"),
                mttr.alias("mttr_promedio"),
                again.alias("reincidencia_sistema"),
            ),
        }
    )


def explain_rul(df: DataFrame) -> DataFrame:
    """Needs rul50_d and rul90_d; model parameters are passed on where the table has them."""
    parameters = [c for c in ("modelo_usado", "lambda", "k", "n_observaciones", "tbf_base") if c in df.columns]
    rul50, rul90 = F.col("rul50_d"), F.col("rul90_d")
    level = F.col("urgencia")

    def by_level(critical: str, high: str, medium: str, low: str) -> Column:
        return (
            F.when(level == "CRÍTICA", critical)
            .when(level == "ALTA", high)
            .when(level == "MEDIA", medium)
            .otherwise(low)
        )

    plan = (
        F.when(level == "CRÍTICA", _texts(*_PLAN_CRITICAL))
        .when(level == "ALTA", _texts(*_PLAN_HIGH))
        .otherwise(_texts(*_PLAN_NORMAL))
    )
    deadline = by_level("inmediata", "esta semana", "próximas 2 semanas", "próximo mes")
    danger = by_level(
        "muy alto de falla inminente",
        "alto si no se interviene pronto",
        "moderado con ventana de intervención",
        "bajo con tiempo suficiente para planificar",
    )
    return df.withColumn("urgencia", urgency(rul50, rul90)).withColumns(
        {
            "resumen": F.concat(
                F.lit("Equipo "),
                F.col("codigo"),
                F.lit(": RUL-50 = "),
                fixed(rul50, 0),
                F.lit(" días, RUL-90 = "),
                fixed(rul90, 0),
                F.lit(" días. Urgencia: "),
                level,
            ),
            "ventana_intervencion": F.concat(F.lit("Intervención recomendada "), deadline),
            "plan_5_pasos": plan,
            "urgencia_dias": rul90.cast("bigint"),
            "riesgos_si_no": F.concat(F.lit("Riesgo "), danger),
            "repuestos_criticos": _texts(*_CRITICAL_PARTS),
            "parametros_modelo": F.struct(*parameters) if parameters else F.lit(None),
        }
    )


def explain_forecast(df: DataFrame) -> DataFrame:
    """Needs forecast_7d_h, forecast_30d_h, horas_por_dia and confianza."""
    week, month, rate = F.col("forecast_7d_h"), F.col("forecast_30d_h"), F.col("horas_por_dia")
    level = F.col("intensidad_uso")
    heavy = level.isin("MUY ALTA", "ALTA")
    impact = (
        F.when(level == "MUY ALTA", "acelerado desgaste y mayor probabilidad de falla")
        .when(level == "ALTA", "desgaste acelerado requiere monitoreo cercano")
        .when(level == "MEDIA", "uso normal dentro de parámetros esperados")
        .otherwise("uso reducido permite mantenimiento programado")
    )
    advice = F.when(F.col("confianza") == "ALTA", "Usar para planificación detallada").otherwise(
        "Validar con datos operativos"
    )
    hours = F.concat(fixed(week, 0), F.lit("h/7d y "), fixed(month, 0), F.lit("h/30d"))
    return df.withColumn("intensidad_uso", band(rate, "usage")).withColumns(
        {
            "resumen": F.concat(F.lit("Proyección uso para "), F.col("codigo"), F.lit(": "), hours),
            "horas_diarias": fixed(rate, 1),
            "bullets_accionables": F.array(
                F.concat(F.lit("Proyección uso: "), hours, F.lit(" (intensidad "), level, F.lit(")")),
                F.concat(F.lit("Impacto: "), impact),
                F.concat(F.lit("Confianza del modelo: "), F.col("confianza"), F.lit(" - "), advice),
                F.when(heavy, "SCHEDULER: Considerar rotación de equipos para reducir carga").otherwise(
                    "SCHEDULER: Ventana disponible para mantenimiento programado"
                ),
                F.when(heavy, "COMPRAS: Acelerar adquisición de repuestos de desgaste").otherwise(
                    "COMPRAS: Proceder con cronograma normal de repuestos"
                ),
            ),
            "scheduler": F.when(heavy, "Rotación de equipos").otherwise("Mantenimiento programado"),
            "compras": F.when(heavy, "Acelerar repuestos").otherwise("Cronograma normal"),
        }
    )


def explain_anomaly(df: DataFrame) -> DataFrame:
    """Needs anomaly_score and the key anomaly features."""
    score = F.col("anomaly_score")
    med, trend = F.col("tbf_med_30d"), F.col("tbf_trend")
    n30, ratio = F.col("ingresos_30d"), F.col("ratio_actividad_30_60")
    change, systems = F.col("cambio_mttr"), F.col("sistemas_unicos_30d")
    findings = _listed(
        (
            trend < -1,
            F.concat(F.lit("Tendencia decreciente en TBF: "), fixed(trend, 1), F.lit(" días/evento")),
        ),
        (
            (med > 0) & (med < 10),
            F.concat(F.lit("TBF anormalmente bajo: "), fixed(med, 0), F.lit(" días promedio")),
        ),
        (n30 >= 3, F.concat(F.lit("Alta frecuencia: "), n30, F.lit(" ingresos en 30 días"))),
        (
            ratio > 2,
            F.concat(F.lit("Actividad reciente "), fixed(ratio, 1), F.lit("x mayor que histórica")),
        ),
        (
            change > 1.5,
            F.concat(F.lit("MTTR aumentó "), fixed(change, 1), F.lit("x respecto a histórico")),
        ),
        (systems > 2, F.concat(F.lit("Múltiples sistemas afectados: "), systems)),
        otherwise=F.array(
            F.when(score > 0.6, "Combinación de factores menores genera patrón atípico").otherwise(
                "Operación dentro de patrones normales"
            )
        ),
    )
    checks = (
        F.when(
            score >= 0.8,
            _texts(
                "Inspección visual completa del equipo HOY",
                "Verificación de parámetros operativos críticos",
            ),
        )
        .when(
            score >= 0.6,
            _texts(
                "Revisión de registros de mantenimiento reciente",
                "Análisis de condiciones operativas actuales",
            ),
        )
        .otherwise(_texts("Continuar con programa normal de monitoreo"))
    )
    return df.withColumns(
        {
            "resumen": F.concat(
                F.lit("Equipo "),
                F.col("codigo"),
                F.lit(" presenta score de anomalía = "),
                fixed(score, 2),
            ),
            "anomalias_detectadas": F.slice(findings, 1, 3),
            "chequeos_recomendados": checks,
        }
    )


def anomaly_reasons(df: DataFrame) -> DataFrame:
    """Short reasons beside a score."""
    n30, systems = F.col("ingresos_30d"), F.col("sistemas_unicos_30d")
    return df.withColumn(
        "explicacion",
        _listed(
            (n30 > 3, F.concat(F.lit("Alta frecuencia de ingresos: "), n30, F.lit(" en 30 días"))),
            (F.col("tbf_trend") < -1, "Tendencia decreciente en tiempo entre fallas"),
            (systems > 2, F.concat(F.lit("Múltiples sistemas afectados: "), systems)),
            (F.col("cambio_mttr") > 1.5, "Aumento significativo en tiempo de reparación"),
            otherwise=_texts("Patrones operativos dentro de rangos normales"),
        ),
    )
