"""Operations analytics as lazy DataFrame operators on stock Spark."""
