"""Structure discovery in tables, surveys and graphs on Spark: columns become two-sided
features, and consistent choices of sides are searched level by level."""

__version__ = "0.1.0"
