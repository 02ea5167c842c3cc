"""Word lists that results depend on."""

from __future__ import annotations

#: Provinces and cities of each region, in the order in which regions are tried.
REGIONS = {
    "Bac": [
        "hà nội", "hải phòng", "quảng ninh", "bắc ninh", "hải dương", "hưng yên", "hà nam", "nam định", "thái bình", "ninh bình", "vĩnh phúc", "phú thọ", "thái nguyên",
        "bắc giang", "lạng sơn", "tuyên quang", "hà giang", "cao bằng", "bắc kạn", "lào cai", "yên bái", "điện biên", "lai châu", "sơn la", "hòa bình",
    ],
    "Trung": [
        "thanh hóa", "nghệ an", "hà tĩnh", "quảng bình", "quảng trị", "thừa thiên huế", "đà nẵng", "quảng nam", "quảng ngãi", "bình định", "phú yên", "khánh hòa",
        "ninh thuận", "bình thuận", "kon tum", "gia lai", "đắk lắk", "đắk nông", "lâm đồng",
    ],
    "Nam": [
        "hồ chí minh", "bình dương", "đồng nai", "bà rịa - vũng tàu", "tây ninh", "bình phước", "long an", "tiền giang", "bến tre", "trà vinh", "vĩnh long",
        "đồng tháp", "an giang", "kiên giang", "cần thơ", "hậu giang", "sóc trăng", "bạc liêu", "cà mau", "tp.hcm", "tphcm", "sài gòn",
    ],
}
OTHER_REGION = "Khac"

#: Words of which a receipt's address holds at least one.
ADDRESS_WORDS = [
    "đường", "phố", "ngõ", "ngách", "hẻm", "số", "phường", "quận", "huyện", "thị xã", "thành phố", "tỉnh", "p.", "q.", "tp.", "tx.", "h.", "t.", "kdc", "khu", "tổ", "chợ", "toà", "tầng", "ấp", "thôn", "xã",
    "hà nội", "quảng ninh", "hồ chí minh", "hải phòng", "đà nẵng", "gia lâm", "cẩm phả", "đống đa", "cầu giấy", "ba đình", "hoàn kiếm", "bình thạnh", "gò vấp", "tân phú",
]
