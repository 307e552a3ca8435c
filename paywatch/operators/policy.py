"""Deterministic policy, action gate, human decisions and roles."""

from pyspark.sql import functions as F

from paywatch import fixed


def policy_matrix(spark):
    return spark.createDataFrame(fixed.POLICY_MATRIX, "risk_level string, default_action string, default_approval boolean")


def evaluate(df, overrides, incomplete="incomplete"):
    """Allowed action and need for approval by risk level.

    ``overrides`` (merchant_id, risk_level, own_action, own_approval) wins where it has the merchant's level; evidence
    without confidence always forces approval. The default matrix has four rows.
    """
    matrix = F.broadcast(policy_matrix(df.sparkSession))
    return (
        df.join(matrix, "risk_level", "left")
        .join(overrides, ["merchant_id", "risk_level"], "left")
        .selectExpr(
            *df.columns,
            "coalesce(own_action, default_action, 'monitor') as allowed_action",
            f"coalesce(own_approval, default_approval, false) or {incomplete} as requires_human_approval",
        )
    )


def gate(df):
    """Mild actions pass when policy asks for no approval; all else waits for a person."""
    free = ", ".join(f"'{a}'" for a in fixed.SELF_APPROVED_ACTIONS)
    passes = f"allowed_action in ({free}) and not requires_human_approval"
    return df.selectExpr(
        "*", f"{passes} as is_authorized", f"not ({passes}) as requires_human_review",
        f"if({passes}, 'not_required', 'pending') as human_review_status",
    )


def apply_decisions(gated, decisions, key="alert_id"):
    """The newest approve / reject decision sets authorisation and status."""
    newest = decisions.groupBy(key).agg(F.expr("max_by(decision, decided_us) as decision"))
    return gated.join(newest, key, "left").selectExpr(
        *[c for c in gated.columns if c not in ("is_authorized", "human_review_status")],
        "case decision when 'approve' then true when 'reject' then false else is_authorized end as is_authorized",
        "case decision when 'approve' then 'approved' when 'reject' then 'rejected' else human_review_status end"
        " as human_review_status",
    )


def role_grants(spark):
    return spark.createDataFrame(list(fixed.ROLE_PERMISSIONS.items()), "role string, granted array<string>")


def permitted(requests):
    """Requests (role, permission) the role may make: granted by name or by the wildcard. The role table is fixed."""
    joined = requests.join(F.broadcast(role_grants(requests.sparkSession)), "role")
    return joined.where("array_contains(granted, '*') or array_contains(granted, permission)").drop("granted")


def may_approve(role="role"):
    """Whether a role may approve actions."""
    return F.col(role).isin(*fixed.APPROVER_ROLES)


def band_thresholds(df, overrides):
    """Adds the score-band thresholds, a merchant's own where it has any."""
    return df.join(overrides, "merchant_id", "left").selectExpr(
        *df.columns,
        f"coalesce(own_block, {fixed.BLOCK_SCORE}) as block_threshold",
        f"coalesce(own_review, {fixed.REVIEW_SCORE}) as review_threshold",
        f"coalesce(own_multiplier, {fixed.SPIKE_MULTIPLIER}D) as spike_multiplier",
    )
