"""Verdict strings. Reports are compared on these texts."""

SIGNIFICANT = "Significant (p < 0.05)"
NOT_SIGNIFICANT = "Not Significant (p >= 0.05)"

BAYES_STRONG_B = "Strong evidence for Variant B (P > 95%)"
BAYES_MODERATE_B = "Moderate evidence for Variant B (P > 90%)"
BAYES_STRONG_A = "Strong evidence for Control A (P(B) < 10%)"
BAYES_INCONCLUSIVE = "Inconclusive (P ~ 50%)"
BAYES_WEAK = "Weak evidence, continue test"

EFFECT_NEGLIGIBLE = "Negligible (|h| < 0.2)"
EFFECT_SMALL = "Small (0.2 <= |h| < 0.5)"
EFFECT_MEDIUM = "Medium (0.5 <= |h| < 0.8)"
EFFECT_LARGE = "Large (|h| >= 0.8)"

SRM_NAME = "SRM Test Result"
SRM_DETECTED = "❌ SRM DETECTED (p < 0.01) - DO NOT TRUST TEST RESULTS"
SRM_POSSIBLE = "⚠️ Possible SRM (p < 0.05) - Investigate"
SRM_NONE = "✅ No SRM detected (p >= 0.05)"
SRM_NO_DATA = "Insufficient data"

GUARDRAIL_PASS = "✅ PASS"
BOUNCE_FAIL = "❌ FAIL: Bounce rate +5pp"
DURATION_FAIL = "❌ FAIL: Duration -20%"
CART_FAIL = "❌ FAIL: Abandonment +10pp"

LOWER_IS_BETTER = "✅ Variant better (lower is better)"
HIGHER_IS_BETTER = "✅ Variant better (higher is better)"
VARIANT_WORSE = "❌ Variant worse"

UNKNOWN_VARIANT = "Unknown"

DECISION_LAUNCH = "Launch Variant B"
DECISION_KEEP = "Keep Control A"
LAUNCH_ARM = "Launch "
KEEP_ARM = "Keep "
DECISION_FOLLOW_UP = "Run Follow-up Test"
DECISION_INVALID = "Invalid Test (SRM/Guardrail failure)"
