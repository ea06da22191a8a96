"""Vietnamese names and words that stay whole pieces of the target vocabulary."""

# The term list, in the order in which the terms are applied.
VIETNAMESE_TERMS = (
    "Hà Nội", "Sài Gòn", "Hồ Chí Minh", "Việt Nam", "Huế", "Đà Nẵng", "Cần Thơ",
    "Hải Phòng", "Nha Trang", "Vũng Tàu", "Đà Lạt", "Phú Quốc", "Hạ Long",
    "Tây Nguyên", "Mekong", "Hồng", "Cửu Long", "Trường Sa", "Hoàng Sa",
    "Tết", "Âm lịch", "Dương lịch", "Nguyễn", "Trần", "Lê", "Phạm", "Hoàng",
    "Huỳnh", "Phan", "Vũ", "Võ", "Đặng", "Bùi", "Đỗ", "Hồ", "Ngô", "Dương", "Lý",
)
